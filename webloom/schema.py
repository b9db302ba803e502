"""The 90 columns of a page row, in order, with their native types.

The typed form has arrays, numbers and booleans; the wire form has 90 strings, lists joined by a line feed, and ``''`` for
what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

# Names in the order of the table; S string, I int, N bigint, L list of strings, B boolean.
KINDS: dict[str, str] = {
    "url": "S", "final_url": "S", "http_status": "I", "fetch_status": "S", "fetch_error": "S", "page_title": "S", "domain": "S", "site_name": "S", "meta_description": "S", "meta_keywords": "S",
    "og_title": "S", "og_description": "S", "og_type": "S", "og_image": "S", "og_url": "S", "og_site_name": "S", "og_locale": "S", "twitter_card": "S", "twitter_title": "S",
    "twitter_description": "S", "twitter_image": "S", "twitter_handle": "S", "canonical_url": "S", "robots_meta": "S", "viewport": "S", "language": "S", "charset": "S", "favicon": "S",
    "generator": "S", "h1_text": "S", "h1_count": "I", "h2_count": "I", "h3_count": "I", "h4_count": "I", "word_count": "I", "character_count": "I", "rendering_type": "S", "internal_links": "I",
    "internal_links_list": "L", "external_links": "I", "external_links_list": "L", "total_links": "I", "external_domains": "I", "external_domains_list": "L", "all_urls_count": "I", "all_urls": "L",
    "image_urls_count": "I", "image_urls": "L", "images_count": "I", "images_missing_alt": "I", "document_links_count": "I", "document_links": "L", "media_urls_count": "I", "media_urls": "L",
    "iframe_urls": "L", "iframes_count": "I", "script_urls": "L", "scripts_count": "I", "stylesheet_urls": "L", "styles_count": "I", "rss_feeds": "L", "hreflang_urls": "L", "nav_links": "L",
    "forms_count": "I", "social_links": "L", "facebook_url": "S", "linkedin_url": "S", "instagram_url": "S", "youtube_url": "S", "github_url": "S", "mailto_links": "L", "tel_links": "L",
    "contact_emails": "L", "contact_phones": "L", "org_name": "S", "org_description": "S", "org_logo": "S", "org_url": "S", "org_founding_date": "S", "org_location": "S", "org_phone": "S",
    "jsonld_types": "L", "https": "B", "technology": "S", "technology_evidence": "S", "copyright_text": "S", "page_size_bytes": "N", "response_time_ms": "N", "headings_outline": "S",
    "visible_text_preview": "S",
}
COLUMNS = list(KINDS)
LISTS = [c for c, k in KINDS.items() if k == "L"]
NUMBERS = [c for c, k in KINDS.items() if k in "IN"]
_TYPES = {"S": StringType(), "I": IntegerType(), "N": LongType(), "L": ArrayType(StringType()), "B": BooleanType()}
GROUPS = {"source": "url", "meta": "meta_description", "twitter": "twitter_card", "seo": "canonical_url", "content": "h1_text", "links": "internal_links", "assets": "images_count", "social": "social_links", "organisation": "org_name", "technology": "https", "snapshot": "headings_outline"}
# Count columns and the lists whose length they hold.
COUNTED = {
    "internal_links": "internal_links_list", "external_links": "external_links_list", "external_domains": "external_domains_list", "all_urls_count": "all_urls",
    "image_urls_count": "image_urls", "document_links_count": "document_links", "media_urls_count": "media_urls",
}


def _group(name: str) -> str:
    at = COLUMNS.index(name)
    return [g for g, first in GROUPS.items() if COLUMNS.index(first) <= at][-1]


TYPED = StructType([StructField(c, _TYPES[k], True, {"comment": f"{_group(c)} | {c.replace('_', ' ')}"}) for c, k in KINDS.items()])
WIRE = StructType([StructField(c, StringType(), True) for c in COLUMNS])


def data_dictionary() -> list[tuple[str, str, str, str]]:
    """Number, name, type and group of each column."""
    return [(str(i), f.name, f.dataType.simpleString(), _group(f.name)) for i, f in enumerate(TYPED.fields, 1)]


def check_columns(df: DataFrame) -> DataFrame:
    """The 90 columns in order; an unknown one raises, missing ones come out NULL."""
    unknown = sorted(set(df.columns) - set(COLUMNS))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(TYPED[c].dataType).alias(c) for c in COLUMNS])


def _to_wire(name: str) -> Column:
    c, kind = F.col(name), KINDS[name]
    if name == "jsonld_types":
        return F.array_join(c, " ; ")
    if kind == "L":
        return F.array_join(c, "\n")
    if kind == "B":
        return F.when(c, "true").otherwise("false")
    return c.cast("string")


def to_wire(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows as 90 strings, NULL as ``''``, after the columns ``keep``; others are dropped."""
    return df.select(*keep, *[F.coalesce(_to_wire(c), F.lit("")).alias(c) for c in COLUMNS])


def _to_typed(name: str) -> Column:
    c, kind = F.col(name), KINDS[name]
    if kind == "L":
        parts = F.split(F.coalesce(c, F.lit("")), " ; " if name == "jsonld_types" else "\n")
        return F.filter(parts, lambda x: x != "")
    if kind in "IN":
        # "12.0" counts as 12, as a number does; what is no number is NULL.
        return F.trim(c).try_cast("double").cast(_TYPES[kind].simpleString())
    if kind == "B":
        return F.lower(F.trim(c)) == "true"
    return F.coalesce(c, F.lit(""))


def to_typed(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Wire rows with their native types, after the columns ``keep``; the inverse of ``to_wire`` for rows that it made."""
    return df.select(*keep, *[_to_typed(c).alias(c) for c in COLUMNS])
