"""Queries over planted pages: each row of ``pages`` gives its number to one page whose every column is known beforehand.

``~`` stands for the number.  The SQL states the columns' expected values, so that it is independent of how pages are parsed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schema
from webloom.operators import audit
from webloom.operators.extract import extract
from webloom.sources.tables import spread, table

ADDRESS = "https://www.shop~.example/dir/page.html"
PAGE = """<!doctype html><html lang="de"><head><title> Lamps ~
 &amp; more </title><meta name="description" content="About ~"><meta name="Description" content="second ~"><meta name="keywords" content="lamp ~, table">
<meta property="og:title" content="Shown ~"><meta property="og:description" content="Told ~"><meta property="og:type" content="website"><meta property="og:image" content="/og~.png"><meta property="og:url" content="https://www.shop~.example/og"><meta property="og:locale" content="de_DE">
<meta name="twitter:card" content="summary"><meta name="twitter:title" content="Short ~"><meta name="twitter:description" content="Brief ~"><meta name="twitter:image" content="/tw~.png"><meta name="twitter:creator" content="maker~">
<meta name="robots" content="noindex"><meta name="viewport" content="width=~"><meta name="generator" content="Drupal ~"><link rel="canonical" href="https://www.shop~.example/c"><link rel="icon" href="/i~.ico"><link rel="stylesheet" href="/s~.css"><link rel="alternate" type="application/atom+xml" href="/feed~"><link rel="alternate" hreflang="fr" href="/fr/~">
<script type="application/ld+json">[{"@type": ["Store", "Shop"], "name": "House ~", "description": "Sells ~", "url": "https://house~.example/", "logo": {"url": "https://house~.example/l.png"}, "foundingDate": "1~", "telephone": "+49 30 5550~", "email": "mailto:ld~@house.example", "address": {"streetAddress": "Weg ~", "addressLocality": "Ulm"}}, {"@type": "WebSite", "name": "second ~"}]</script>
<script src="/jquery-~.js"></script></head><body><nav><a href="/n~">menu</a><a href="sub/m~">more</a></nav>
<h1>First ~ <em>line</em></h1><p>Write to desk~@shop.example or ring +44 20 7946 0~, no <span hidden>secret ~</span><b>delay</b>.</p><h2>Part A~</h2><div style="display:none"><p>hidden ~</p></div><h3>Part B~</h3><h2 aria-hidden="true">gone</h2>
<ul><li>one ~</li><li>two</li></ul><a href="https://other~.example/x">out</a><a href="https://cdn.shop~.example/list~.pdf">list</a><a href="https://github.com/g~">code</a><a href="https://www.facebook.com/f~">fb</a><a href="/film~.mp4">film</a>
<a href="MAILTO:sales~@shop.example?subject=x">mail</a><a href="tel:+49 555 100~">call</a><a href="#top">top</a><a href="javascript:void(0)">js</a>
<img src="/a~.jpg" alt="lamp"><img data-src="/b~.jpg"><picture><source srcset="/c~.webp 1x, /d~.webp 2x"></picture><audio src="/s~.mp3"></audio><iframe src="https://player.vimeo.com/video/~"></iframe><form></form><form></form>
<footer>Copyright 20~ House ~</footer></body></html>"""
TEXT = "menumore\nFirst ~ line\nWrite to desk~@shop.example or ring +44 20 7946 0~, no delay.\nPart A~\nPart B~\none ~\ntwo\nout\nlist\ncode\nfb\nfilm\nmail\ncall\ntop\njs\nCopyright 20~ House ~"
HERE = "https://www.shop~.example"
META = {
    "page_title": "Lamps ~ & more", "language": "de", "meta_description": "About ~", "meta_keywords": "lamp ~, table", "og_title": "Shown ~", "og_description": "Told ~", "og_type": "website", "og_image": "/og~.png", "og_url": f"{HERE}/og", "og_site_name": "", "og_locale": "de_DE", "twitter_card": "summary", "twitter_title": "Short ~",
    "twitter_description": "Brief ~", "twitter_image": "/tw~.png", "twitter_handle": "@maker~", "robots_meta": "noindex", "viewport": "width=~", "generator": "Drupal ~", "canonical_url": f"{HERE}/c", "favicon": "/i~.ico", "domain": "www.shop~.example", "site_name": "Lamps ~ & more", "https": "true", "technology": "Drupal", "technology_evidence": "generator:Drupal; lib:jquery",
}
OUT = ["https://cdn.shop~.example/list~.pdf", "https://github.com/g~", "https://other~.example/x", "https://www.facebook.com/f~"]
INNER = [f"{HERE}/dir/sub/m~", f"{HERE}/film~.mp4", f"{HERE}/n~"]
LISTED = {
    "internal_links_list": INNER, "external_links_list": OUT, "external_domains_list": ["cdn.shop~.example", "github.com", "other~.example", "www.facebook.com"], "image_urls": [f"{HERE}/a~.jpg", f"{HERE}/b~.jpg", f"{HERE}/c~.webp", f"{HERE}/og~.png"], "document_links": OUT[:1],
    "media_urls": ["https://player.vimeo.com/video/~", f"{HERE}/film~.mp4", f"{HERE}/s~.mp3"], "iframe_urls": ["https://player.vimeo.com/video/~"], "script_urls": [f"{HERE}/jquery-~.js"], "stylesheet_urls": [f"{HERE}/s~.css"], "rss_feeds": [f"{HERE}/feed~"], "hreflang_urls": [f"{HERE}/fr/~"], "nav_links": [f"{HERE}/dir/sub/m~", f"{HERE}/n~"],
    "social_links": ["https://github.com/g~", "https://www.facebook.com/f~"], "mailto_links": ["sales~@shop.example"], "tel_links": ["+49 555 100~"], "contact_emails": ["desk~@shop.example", "ld~@house.example", "sales~@shop.example"], "contact_phones": ["+44 20 7946 0~", "+49 30 5550~", "+49555100~"],
    "all_urls": [*OUT[:3], "https://player.vimeo.com/video/~", OUT[3], *(f"{HERE}/{x}" for x in ("a~.jpg", "b~.jpg", "c~.webp", "dir/sub/m~", "feed~", "film~.mp4", "fr/~", "i~.ico", "jquery-~.js", "n~", "og~.png", "s~.css", "s~.mp3"))],
}
LINKS = {c: "\n".join(x) for c, x in LISTED.items()} | {"facebook_url": "https://www.facebook.com/f~", "github_url": "https://github.com/g~", "linkedin_url": "", "instagram_url": "", "youtube_url": ""}
COUNTS = {n: len(LISTED[c]) for n, c in schema.COUNTED.items()} | {"total_links": 7, "images_count": 2, "images_missing_alt": 1, "iframes_count": 1, "scripts_count": 2, "styles_count": 1, "forms_count": 2, "h1_count": 1, "h2_count": 1, "h3_count": 1, "h4_count": 0}
CONTENT = {"h1_text": "First ~ line", "headings_outline": "h1: First ~ line | h2: Part A~ | h3: Part B~", "rendering_type": "server_rendered", "copyright_text": "Copyright 20~ House ~", "visible_text_preview": TEXT}
ORGANISATION = {"org_name": "House ~", "org_description": "Sells ~", "org_logo": "https://house~.example/l.png", "org_url": "https://house~.example/", "org_founding_date": "1~", "org_location": "Weg ~, Ulm", "org_phone": "+49 30 5550~", "jsonld_types": "Shop ; Store ; WebSite"}
# Pages without much on them: (page, rendering_type, technology, technology_evidence), by number modulo their count.
BARE = [
    ("", "", "", ""), ('<html><body><div id="root"></div></body></html>', "client_rendered", "", ""), ("<html><body></body></html>", "empty", "", ""), ("<body><p>three plain words</p></body>", "server_rendered", "", ""),
    ('<body><script src="/_next/~.js"></script></body>', "client_rendered", "Next.js", "mark:next.js"), ('<body><p>one ~</p><img src="/wp-content/~.png"></body>', "server_rendered", "WordPress", "path:wp-content"),
]


def _filled(text: str) -> str:
    return "replace(concat('" + text.replace("'", "''").replace("\n", "', chr(10), '") + "'), '~', CAST(page_id AS VARCHAR))"


def _sql(expected: dict[str, str]) -> str:
    return "SELECT page_id, " + ", ".join(f"{_filled(v)} AS {c}" for c, v in expected.items()) + " FROM pages"


def _planted(spark: SparkSession, d: str, page: str = PAGE) -> DataFrame:
    fill = lambda text: F.replace(F.lit(text), F.lit("~"), F.col("page_id").cast("string"))
    return extract(spread(table(spark, d, "pages").select("page_id", fill(ADDRESS).alias("url"), fill(page).alias("html"))), ("page_id",))


def _wire(spark: SparkSession, d: str, columns: dict) -> DataFrame:
    return schema.to_wire(_planted(spark, d), ("page_id",)).select("page_id", *columns)


def planted_meta(spark: SparkSession, d: str) -> DataFrame:
    return _wire(spark, d, META)


def planted_links(spark: SparkSession, d: str) -> DataFrame:
    return _wire(spark, d, LINKS)


def planted_content(spark: SparkSession, d: str) -> DataFrame:
    return _planted(spark, d).select("page_id", *CONTENT, "word_count", "character_count")


def planted_organisation(spark: SparkSession, d: str) -> DataFrame:
    return _wire(spark, d, ORGANISATION)


def planted_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers after a round trip through the wire form."""
    return schema.to_typed(schema.to_wire(_planted(spark, d), ("page_id",)), ("page_id",)).select("page_id", *COUNTS)


def planted_rendering(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    page = F.element_at(F.array(*[F.lit(p) for p, *_ in BARE]), (F.pmod("page_id", F.lit(len(BARE))) + 1).cast("int"))
    rows = table(spark, d, "pages").select("page_id", F.lit("https://a.example/").alias("url"), F.replace(page, F.lit("~"), number).alias("html"))
    return extract(spread(rows), ("page_id",)).select("page_id", "rendering_type", "technology", "technology_evidence")


def planted_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows spoilt in three ways by turns; the audit must name each fault and no other."""
    turn = F.pmod("page_id", F.lit(4))
    spoilt = _planted(spark, d).withColumns({
        "internal_links": F.when(turn == 0, F.col("internal_links") + 1).otherwise(F.col("internal_links")), "image_urls": F.when(turn == 1, F.reverse("image_urls")).otherwise(F.col("image_urls")),
        "rss_feeds": F.when(turn == 2, F.concat("rss_feeds", "rss_feeds")).otherwise(F.col("rss_feeds")),
    })
    return audit.violations(spoilt, "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (planted_meta, planted_links, planted_content, planted_organisation, planted_counts, planted_rendering, planted_violations)}


def oracle_sql() -> dict[str, str]:
    words = len(TEXT.split())
    case = lambda i: "CASE page_id % " + str(len(BARE)) + " " + " ".join(f"WHEN {k} THEN '{row[i]}'" for k, row in enumerate(BARE)) + " END"
    return {
        "planted_meta": _sql(META), "planted_links": _sql(LINKS), "planted_organisation": _sql(ORGANISATION),
        "planted_content": _sql(CONTENT).replace(" FROM pages", f", CAST({words} AS INTEGER) AS word_count, CAST(length({_filled(TEXT)}) AS INTEGER) AS character_count FROM pages"),
        "planted_counts": "SELECT page_id, " + ", ".join(f"CAST({v} AS INTEGER) AS {c}" for c, v in COUNTS.items()) + " FROM pages",
        "planted_rendering": f"SELECT page_id, {case(1)} AS rendering_type, {case(2)} AS technology, {case(3)} AS technology_evidence FROM pages",
        "planted_violations": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'count' ELSE 'sorted_distinct' END AS "check", CASE page_id % 4 WHEN 0 THEN 'internal_links' WHEN 1 THEN 'image_urls' ELSE 'rss_feeds' END AS "column" FROM pages WHERE page_id % 4 < 3""",
    }
