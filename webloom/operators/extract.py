"""Pages to rows of 90 columns: one parse, then expressions on its struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators.parse import parse_page
from webloom.schema import COLUMNS, KINDS, TYPED

# Fixed values.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE_INTERNATIONAL = r"\+[0-9][0-9\s\-\.\(\)]{6,18}[0-9]"
PHONE_NATIONAL = r"\(?\d{3}\)?[\s\-\.]\d{3}[\s\-\.]\d{4}"
COPYRIGHT = r"(?i)(?:©|&copy;|\(c\)|Copyright|All rights reserved)[^\n]{0,120}"
GENERATORS = {"wordpress": "WordPress", "wp": "WordPress", "shopify": "Shopify", "squarespace": "Squarespace", "wix": "Wix", "webflow": "Webflow", "joomla": "Joomla!", "drupal": "Drupal", "ghost": "Ghost", "medium": "Medium", "hubspot": "HubSpot", "elementor": "Elementor", "typo3": "TYPO3", "prestashop": "PrestaShop", "magento": "Magento"}
TECHNOLOGIES = {"path:wp-content": "WordPress", "cdn:shopify": "Shopify", "mark:squarespace": "Squarespace", "mark:webflow": "Webflow", "mark:next.js": "Next.js", "mark:nuxt.js": "Nuxt.js", "mark:gatsby": "Gatsby", "mark:vue": "Vue.js", "attr:angular": "Angular", "mark:react": "React", "lib:jquery": "jQuery"}



def _or(*options: Column) -> Column:
    """The first that is neither NULL nor empty, else ``''``."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _sorted(array: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(array, lambda x: x.isNotNull() & (x != ""))))


def _meta(page: Column, field: str, value: str) -> Column:
    """Content of the first meta element of that name, even if it's empty."""
    return F.coalesce(_first(F.filter(page["metas"], lambda m: m[field] == value))["content"], F.lit(""))


def _header(headers: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.element_at(headers, n), F.lit("")) for n in names])


def _on_hosts(hosts: list[str]):
    return lambda u: urls.host_is(urls.host(u), hosts)


def _tagged(tag: str):
    return lambda x: x["tag"] == tag


def rendering_type(html: Column, blocks: Column) -> Column:
    """``empty``, ``client_rendered`` or ``server_rendered``; ``''`` without a page."""
    low = F.lower(html)
    marker = html.rlike(r"__NEXT_DATA__|__NUXT__|appServerConfig|__spotify|\bid=[\"'](?:root|app|__next|__nuxt)[\"']|id=\"app-root\"") | low.rlike("data-reactroot|data-react-id|ng-version")
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    raw = F.when(html.rlike(r"(?is)<body[^>]*>.*?</body>"), body).otherwise(html)
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", " "), r"(?U)\s+", " "))
    words = F.size(F.filter(F.split(F.array_join(F.transform(blocks, lambda b: b["text"]), " "), " "), lambda w: w != ""))
    return (
        F.when(F.coalesce(html, F.lit("")) == "", F.lit(""))
        .when(F.size(blocks) == 0, F.when(marker | (F.contains(low, F.lit("<script")) & (bare == "")), "client_rendered").otherwise("empty"))
        .when((words <= 2) & marker & (bare == ""), "client_rendered")
        .otherwise("server_rendered")
    )


def technology_clues(html: Column, generator: Column, scripts: Column, headers: Column) -> Column:
    """Clues in their fixed order."""
    low, gen, src = F.lower(html), F.lower(generator), F.lower(scripts)
    found = F.lit(None).cast("string")
    for word, name in reversed(GENERATORS.items()):
        found = F.when(F.contains(gen, F.lit(word)), F.lit(f"generator:{name}")).otherwise(found)
    tests = [
        (low.rlike("wp-content|wp-includes|wp-json"), "path:wp-content"), (low.rlike(r"cdn\.shopify\.com|cdn/shopify"), "cdn:shopify"), (low.contains("squarespace"), "mark:squarespace"), (low.contains("webflow"), "mark:webflow"),
        (low.contains("gatsby"), "mark:gatsby"), (html.contains("__NEXT_DATA__") | low.contains("/_next/"), "mark:next.js"), (html.contains("__nuxt") | low.contains("/_nuxt/"), "mark:nuxt.js"),
        (src.contains("vue") | html.contains("__vue__"), "mark:vue"), (src.contains("react") | low.contains("data-reactroot") | low.contains("_reactroot"), "mark:react"),
        (html.rlike(r"(?i)\bng-(version|app|controller)\b"), "attr:angular"), (src.contains("jquery"), "lib:jquery"),
    ]
    powered, server = _header(headers, "X-Powered-By", "x-powered-by"), _header(headers, "Server", "server")
    clues = [found, *[F.when(test, clue) for test, clue in tests], F.concat(F.lit("header:x-powered-by:"), F.trim(powered)), F.concat(F.lit("header:server:"), F.trim(server))]
    return F.array_compact(F.array(*clues))


def technology_label(clues: Column) -> Column:
    generator = F.regexp_extract(F.coalesce(_first(clues), F.lit("")), "^generator:(.*)$", 1)
    label = F.lit("")
    for clue, name in reversed(TECHNOLOGIES.items()):
        label = F.when(F.array_contains(clues, clue), F.lit(name)).otherwise(label)
    # A header's own text may name a product only if nothing better is there.
    return F.when(generator != "", generator).otherwise(label)


def extract(fetched: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 90 typed columns of each fetched page, after the columns ``keep``.

    ``fetched`` has ``url`` and ``html`` and may have ``final_url, http_status, fetch_status, fetch_error, timing`` (milliseconds),
    ``headers`` and ``page_size_bytes``; what is absent or NULL counts as not given.  A NULL or empty page gives the request's columns only; of a
    page that can't be read ``fetch_error`` has the reason, unless the fetch gave one.  The page is parsed once; no row is shuffled and every input row
    gives one row.
    """
    have = set(fetched.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    base = fetched.select(
        *[F.col(k).alias(f"_keep_{i}") for i, k in enumerate(keep)], F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), _or(given("final_url", "string"), F.col("url")).alias("final_url"),
        given("http_status", "int").alias("http_status"), _or(given("fetch_status", "string"), F.lit("ok")).alias("fetch_status"), _or(given("fetch_error", "string")).alias("fetch_error"), given("timing", "bigint").alias("response_time_ms"),
        (given("headers", "map<string,string>")).alias("headers"), F.coalesce(given("page_size_bytes", "bigint"), F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint")).alias("page_size_bytes"),
    )
    p, html = F.col("p"), F.col("html")
    parsed = base.withColumn("p", parse_page(html, F.col("final_url"))).withColumn("domain", urls.host(F.col("final_url")))
    parsed = parsed.withColumn("fetch_error", _or(F.col("fetch_error"), F.concat(F.lit("Page not read: "), F.nullif(p["error"], F.lit("")))))
    meta = {"meta_description": "description", "meta_keywords": "keywords", "twitter_card": "twitter:card", "twitter_title": "twitter:title", "twitter_description": "twitter:description", "twitter_image": "twitter:image", "robots_meta": "robots", "viewport": "viewport", "generator": "generator"}
    og = ("og_title", "og_description", "og_type", "og_image", "og_url", "og_site_name", "og_locale")
    handle = _or(_meta(p, "name", "twitter:site"), _meta(p, "name", "twitter:creator"))
    head = parsed.withColumns(
        {c: _meta(p, "name", n) for c, n in meta.items()}
        | {c: _meta(p, "property", c.replace("_", ":", 1)) for c in og}
        | {
            "twitter_handle": F.when((handle == "") | handle.startswith("@"), handle).otherwise(F.concat(F.lit("@"), handle)),
            "page_title": _or(p["title"]), "language": _or(p["lang"]), "favicon": _or(p["favicon"]), "brand": urls.brand_from_domain(F.col("domain")),
            "canonical_url": F.coalesce(_first(F.filter(p["links"], lambda x: F.array_contains(x["rels"], "canonical")))["href"], F.lit("")),
            "charset": F.coalesce(p["meta_charset"], F.regexp_extract(F.coalesce(_header(F.col("headers"), "Content-Type", "content-type"), F.lit("")), r"(?i)charset\s*=\s*([\w\-]+)", 1)),
            "blocks": p["blocks"], "full_text": F.array_join(F.transform(p["blocks"], lambda b: b["text"]), "\n"),
            "page_urls": F.transform(F.filter(p["anchors"], lambda a: a["url"].isNotNull()), lambda a: a["url"]),
            "own_images": F.flatten(F.transform(p["images"], lambda i: i["urls"])),
            "image_sources": F.transform(F.filter(p["sources"], lambda s: ~(s["parent"].isin("video", "audio") | urls.path_ends_with(s["url"], urls.MEDIA_EXTENSIONS))), lambda s: s["url"]),
            "media_sources": F.transform(F.filter(p["sources"], lambda s: s["parent"].isin("video", "audio") | urls.path_ends_with(s["url"], urls.MEDIA_EXTENSIONS)), lambda s: s["url"]),
            "frames": F.array_compact(F.transform(p["iframes"], lambda f: f["url"])), "script_list": F.array_compact(F.transform(p["scripts"], lambda s: s["url"])),
            "styles": F.array_compact(F.transform(F.filter(p["links"], lambda x: F.array_contains(x["rels"], "stylesheet")), lambda x: x["url"])),
            "feeds": F.array_compact(F.transform(F.filter(p["links"], lambda x: F.array_contains(x["rels"], "alternate") & (x["type"].contains("rss") | x["type"].contains("atom") | (x["type"].contains("xml") & F.contains(F.lower(x["href"]), F.lit("feed"))))), lambda x: x["url"])),
            "alternates": F.array_compact(F.transform(F.filter(p["links"], lambda x: x["hreflang"] != ""), lambda x: x["url"])),
            "mailto_links": _sorted(F.transform(F.filter(p["anchors"], lambda a: F.lower(a["href"]).startswith("mailto:")), lambda a: F.trim(F.substring_index(F.substr(a["href"], F.lit(8)), "?", 1)))),
            "tel_links": _sorted(F.transform(F.filter(p["anchors"], lambda a: F.lower(a["href"]).startswith("tel:")), lambda a: F.trim(F.substring_index(F.substr(a["href"], F.lit(5)), "?", 1)))),
        }
    )
    b, text, own, headings = F.col("blocks"), F.col("full_text"), F.col("domain"), F.filter(F.col("blocks"), lambda x: x["tag"].rlike("^h[1-6]$"))
    is_social = lambda u: urls.host_is(urls.host(u), list(urls.SOCIAL_HOSTS))
    first_social = {}
    for column in ("facebook_url", "linkedin_url", "instagram_url", "youtube_url", "github_url"):
        first_social[column] = F.coalesce(_first(F.filter(F.col("page_urls"), _on_hosts([h for h, c in urls.SOCIAL_HOSTS.items() if c == column]))), F.lit(""))
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    found = lambda pattern, low, high: F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: digits(x).between(low, high))
    dialled = F.filter(F.transform(F.col("tel_links"), lambda t: F.regexp_replace(t, "[^0-9+]", "")), lambda t: digits(t) >= 7)
    j = p["jsonld"]
    lists = head.withColumns(
        {
            "internal_links_list": _sorted(F.filter(F.col("page_urls"), lambda u: ~urls.is_external(u, own))), "external_links_list": _sorted(F.filter(F.col("page_urls"), lambda u: urls.is_external(u, own))),
            "document_links": _sorted(F.filter(F.col("page_urls"), urls.is_document)),
            "media_urls": _sorted(F.concat(F.filter(F.col("page_urls"), urls.is_media), F.col("media_sources"), p["media"], F.filter(F.col("frames"), lambda u: urls.host_is(urls.host(u), urls.MEDIA_HOSTS)))),
            "image_urls": _sorted(F.concat(F.col("own_images"), F.col("image_sources"), F.array(p["og_image_url"]))),
            "all_urls": _sorted(F.concat("page_urls", "own_images", "image_sources", "media_sources", p["media"], "script_list", "styles", "feeds", "alternates", "frames", F.array(p["og_image_url"], p["favicon_url"]))),
            "iframe_urls": _sorted(F.col("frames")), "script_urls": _sorted(F.col("script_list")), "stylesheet_urls": _sorted(F.col("styles")), "rss_feeds": _sorted(F.col("feeds")), "hreflang_urls": _sorted(F.col("alternates")),
            "nav_links": _sorted(F.transform(F.filter(p["anchors"], lambda a: a["in_nav"]), lambda a: a["url"])), "social_links": _sorted(F.filter(F.col("page_urls"), is_social)),
            "contact_emails": _sorted(F.concat(F.regexp_extract_all(text, F.lit(EMAIL), 0), F.flatten(F.transform(F.col("mailto_links"), lambda m: F.regexp_extract_all(m, F.lit(EMAIL), 0))), j["emails"])),
            "contact_phones": _sorted(F.concat(dialled, found(PHONE_INTERNATIONAL, 7, 15), found(PHONE_NATIONAL, 10, 11), j["phones"])),
            "jsonld_types": j["types"], "clues": technology_clues(html, F.col("generator"), F.array_join(F.transform(p["scripts"], lambda s: s["src"]), " "), F.col("headers")),
        }
    )
    count = lambda c: F.size(F.col(c))
    done = lists.withColumns(
        first_social
        | {f"h{k}_count": F.size(F.filter(b, _tagged(f"h{k}"))) for k in (1, 2, 3, 4)}
        | {
            "site_name": _or(F.col("og_site_name"), F.col("page_title"), F.col("brand")), "h1_text": F.coalesce(_first(F.filter(b, lambda x: x["tag"] == "h1"))["text"], F.lit("")),
            "headings_outline": F.array_join(F.transform(headings, lambda x: F.concat(x["tag"], F.lit(": "), x["text"])), " | "),
            "word_count": F.size(F.filter(F.split(text, "[ \n]"), lambda w: w != "")), "character_count": F.length(text), "visible_text_preview": F.left(text, F.lit(500)),
            "rendering_type": rendering_type(html, b), "copyright_text": F.trim(F.regexp_replace(F.regexp_extract(text, COPYRIGHT, 0), r"\s+", " ")),
            "internal_links": count("internal_links_list"), "external_links": count("external_links_list"), "total_links": F.size(F.array_union("internal_links_list", "external_links_list")),
            "external_domains_list": _sorted(F.transform(F.col("external_links_list"), urls.host)), "all_urls_count": count("all_urls"), "image_urls_count": count("image_urls"), "document_links_count": count("document_links"), "media_urls_count": count("media_urls"),
            "images_count": F.size(p["images"]), "images_missing_alt": F.size(F.filter(p["images"], lambda i: i["alt"] == "")), "iframes_count": F.size(p["iframes"]), "scripts_count": F.size(p["scripts"]),
            "styles_count": F.size(F.filter(p["links"], lambda x: x["stylesheet"])), "forms_count": p["forms"],
            "org_name": _or(j["name"], F.col("og_site_name"), F.col("brand"), F.col("page_title")), "org_description": _or(j["description"], F.col("meta_description"), F.col("og_description")), "org_logo": _or(j["logo"], F.col("og_image")),
            "org_url": _or(j["url"], F.col("canonical_url"), F.col("final_url")), "org_founding_date": _or(j["founding"]), "org_location": _or(j["location"]), "org_phone": _or(j["phone"]),
            "https": urls.is_https(F.col("final_url")), "technology": technology_label(F.col("clues")), "technology_evidence": F.array_join("clues", "; "),
        }
    ).withColumn("external_domains", count("external_domains_list"))
    requested = {"url", "final_url", "http_status", "fetch_status", "fetch_error", "domain", "https", "page_size_bytes", "response_time_ms"}

    def column(c: str) -> Column:
        kind = TYPED[c].dataType.simpleString()
        value = F.col(c)
        if c not in requested:
            blank = F.lit("") if KINDS[c] == "S" else F.array().cast("array<string>") if KINDS[c] == "L" else F.lit(None)
            value = F.when(html == "", blank).otherwise(value)
        return value.cast(kind).alias(c)

    return done.select(*[F.col(f"_keep_{i}").alias(k) for i, k in enumerate(keep)], *[column(c) for c in COLUMNS])
