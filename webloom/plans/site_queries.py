"""Queries of the page, address, fetch-log and discovery operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schema
from webloom.functions import urls
from webloom.operators import audit, discover, fetchlog
from webloom.operators import extract as extraction
from webloom.sources.tables import spread, table
from webloom.sources.url_lists import url_lines, vote_for_url_column

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PROXIES = [f"http://p{i:02d}.proxy.invalid:8080" for i in range(7)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract(spread(_pages(spark, d)), ("page_id",))


# Addresses

_STRIP = r"regexp_replace(coalesce(url, ''), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"
_CANON = rf"""
u AS (SELECT *, {_STRIP} AS s FROM src), v AS (SELECT *, CASE WHEN regexp_matches(lower(s), '^https?://') THEN s ELSE 'https://' || s END AS f FROM u),
w AS (SELECT *, lower(regexp_extract(f, '(?i)^(https?)://', 1)) AS scheme, regexp_extract(f, '(?i)^https?://([^/?#]*)', 1) AS auth, regexp_extract(f, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(f, '(?i)^[^?#]*\?([^#]*)', 1) AS query FROM v),
x AS (SELECT *, lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':.*$', '')) AS host,
  list_sort(list_filter(string_split(query, '&'), lambda q: q <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','utm_name','utm_reader','utm_referrer','utm_social','gclid','fbclid','msclkid','dclid','yclid','twclid','igshid','mc_cid','mc_eid','_ga','_gl','ref_src','ref_url','sessionid','session_id','phpsessid','jsessionid','aspsessionid'], lower(string_split(q, '=')[1])))) AS kept,
  regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/{{2,}}', '/', 'g') AS p2 FROM w),
canon AS (SELECT *, CASE WHEN s = '' OR host = '' OR (contains(s, '://') AND NOT regexp_matches(lower(s), '^https?://')) OR regexp_matches(lower(s), '^(mailto|tel|javascript|data|ftp|file|sms|callto|whatsapp|skype):') THEN ''
  ELSE scheme || '://' || host || CASE WHEN length(p2) > 1 THEN regexp_replace(p2, '/$', '') ELSE p2 END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM x)"""


@query(f"SELECT seq, CASE WHEN url IS NULL THEN NULL WHEN starts_with({_STRIP}, 'http://') OR starts_with({_STRIP}, 'https://') THEN {_STRIP} ELSE 'https://' || {_STRIP} END AS normal FROM url_list")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "url_list").select("seq", urls.normalize_url(F.col("url")).alias("normal"))


@query(f"WITH src AS (SELECT seq, url FROM url_list), {_CANON} SELECT seq, canonical FROM canon")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "url_list").select("seq", urls.canonicalize(F.col("url")).alias("canonical"))


@query(f"WITH src AS (SELECT seq, url FROM url_list), {_CANON} SELECT count(*) AS n, count(*) FILTER (query <> '') AS with_query, CAST(sum(len(list_filter(string_split(query, '&'), lambda q: q <> '')) - len(kept)) AS BIGINT) AS removed FROM canon WHERE canonical <> ''")
def url_tracking_removed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "url_list").select(urls.canonicalize(F.col("url"), drop_tracking=False).alias("with"), urls.canonicalize(F.col("url")).alias("without")).where("with <> ''")
    parts = lambda c: F.size(F.filter(F.split(urls.url_part(F.col(c), 4), "&"), lambda p: p != ""))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(urls.url_part(F.col("with"), 4) != "").alias("with_query"), F.sum(parts("with") - parts("without")).alias("removed"))


_HOST = "lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@query(f"SELECT page_id, {_HOST} AS host, regexp_matches(url, '(?i)^https:') AS https, CASE WHEN {_HOST} = '' THEN '' ELSE lower(regexp_extract(url, '^(https?)', 1)) || '://' || regexp_extract(url, '(?i)^https?://([^/?#]*)', 1) END AS origin FROM pages")
def url_host_scheme(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.host(u).alias("host"), urls.is_https(u).alias("https"), urls.origin(u).alias("origin"))


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host, string_split({_HOST}, '.') AS l FROM pages)
SELECT page_id, CASE WHEN len(l) <= 2 OR regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN host WHEN length(l[-1]) = 2 AND l[-2] IN ('co','com','net','org','gov','edu','ac','or','ne','go','in','info','biz','mil','sch') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM h""")
def url_registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.registrable_domain(urls.host(F.col("url"))).alias("domain"))


@query(f"""WITH h AS (SELECT page_id, string_split({_HOST}, '.') AS l FROM pages), k AS (SELECT page_id, l, list_position(list_transform(l, lambda x: x IN ('www','www1','www2','m','mobile','docs','blog','en','de','es','fr','ja','zh','ru','pt','tr','uk','xen')), false) AS a FROM h)
SELECT page_id, array_to_string(list_transform(CASE WHEN a IS NULL OR a >= len(l) THEN l[1:1] ELSE l[a:len(l)-1] END, lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS brand FROM k""")
def url_brand(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.brand_from_domain(urls.host(F.col("url"))).alias("brand"))


@query("""SELECT seq, coalesce(regexp_matches(url, '(?i)^(https?://|www\\.|[a-z0-9-]+\\.[a-z]{2,})'), false) AS looks, coalesce(lower(regexp_extract(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '(\\.[^.]*)$', 1)) IN ('.png','.jpg','.css','.js','.pdf','.zip','.json','.xml'), false) AS skip FROM url_list""")
def url_looks_and_skip(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "url_list").select("seq", urls.looks_like_url(u).alias("looks"), F.coalesce(urls.has_skip_extension(u), F.lit(False)).alias("skip"))


@query("SELECT run_id, url, min(seq) AS seq FROM url_list WHERE url <> '' GROUP BY run_id, url")
def dedupe_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return discover.first_seen(table(spark, d, "url_list"), F.col("url"), "seq", ["run_id"]).withColumnRenamed("key", "url")


@query(f"WITH src AS (SELECT seq, url FROM url_list), {_CANON} SELECT canonical AS url, min(seq) AS seq FROM canon WHERE canonical <> '' GROUP BY 1")
def dedupe_canonical(spark: SparkSession, d: str) -> DataFrame:
    return discover.first_seen(table(spark, d, "url_list"), urls.canonicalize(F.col("url")), "seq").withColumnRenamed("key", "url")


@query("""WITH t AS (SELECT seq, trim(url) AS u FROM url_list) SELECT seq, u AS url FROM t WHERE u <> '' AND NOT starts_with(u, '#') AND regexp_matches(u, '(?i)^(https?://|www\\.|[a-z0-9-]+\\.[a-z]{2,})')""")
def url_list_lines(spark: SparkSession, d: str) -> DataFrame:
    return url_lines(table(spark, d, "url_list").select("seq", F.col("url").alias("line"))).withColumnRenamed("line", "url")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)\\.html') AND NOT regexp_matches(url, '(?i)//(www|m)\\.')")
def include_exclude(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where(F.col("url").rlike(r"(?i)\.html") & ~F.col("url").rlike(r"(?i)//(www|m)\.")).select("page_id", "url")


@query(f"WITH p AS (SELECT page_id, url, {_HOST} AS h FROM pages) SELECT page_id, url FROM p WHERE regexp_matches(h, '(^|\\.)(tolvanmarkt\\.example|brixenware\\.test|example\\.org)$')")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where(urls.same_scope(F.col("url"), ["tolvanmarkt.example", "brixenware.test", "example.org"])).select("page_id", "url")


@query("""SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes, regexp_extract(coalesce(html, ''), '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang, regexp_extract(coalesce(html, ''), '(?i)<meta charset="([^"]*)"', 1) AS charset FROM pages""")
def page_size_lang_charset(spark: SparkSession, d: str) -> DataFrame:
    rows = _extracted(spark, d)
    return rows.select("page_id", F.col("page_size_bytes").alias("bytes"), F.col("language").alias("lang"), "charset")


_DECODE = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
_TITLE = _DECODE.format(r"trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))")


@query(f"SELECT page_id, {_TITLE} AS page_title FROM pages WHERE html LIKE '%</title>%'")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract(spread(_pages(spark, d).where(F.col("html").contains("</title>"))), ("page_id",)).select("page_id", "page_title")


@query("""SELECT page_id, len(regexp_extract_all(html, '<script[ >]')) AS scripts, len(regexp_extract_all(html, '<img[ >]')) AS images, len(regexp_extract_all(html, '<form[ >]')) AS forms, len(regexp_extract_all(html, '<iframe[ >]')) AS iframes FROM pages WHERE html <> ''""")
def element_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _extracted(spark, d).where("page_size_bytes > 0")
    return rows.select("page_id", *[F.col(c).cast("bigint").alias(n) for c, n in (("scripts_count", "scripts"), ("images_count", "images"), ("forms_count", "forms"), ("iframes_count", "iframes"))])


@query()
def full_extract_90(spark: SparkSession, d: str) -> DataFrame:
    return schema.to_wire(_extracted(spark, d))


@query()
def fetched_extract_90(spark: SparkSession, d: str) -> DataFrame:
    """The 90 columns of all fetches, failed ones included, each fetch once."""
    log = fetchlog.fetches_with_bodies(table(spark, d, "fetch_log"), ["url", "final_url", "http_status", "fetch_status", "fetch_error", "html", "timing", "headers"])
    return schema.to_wire(extraction.extract(log, ("fetch_id",)))


@query("SELECT CAST('' AS VARCHAR) AS url, CAST('' AS VARCHAR) AS \"check\", CAST('' AS VARCHAR) AS \"column\" WHERE false")
def audit_violations(spark: SparkSession, d: str) -> DataFrame:
    return audit.violations(_extracted(spark, d))


@query("SELECT fetch_status, count(*) AS n FROM (SELECT DISTINCT site_id, fetch_status FROM sites) GROUP BY 1")
def audit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_histogram(table(spark, d, "sites").select("site_id", "fetch_status").distinct())


@query("SELECT count(*) AS rows_n, 0::BIGINT AS differing FROM pages")
def typed_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = _extracted(spark, d).select(*schema.COLUMNS)
    again = schema.to_typed(schema.to_wire(rows))
    key = lambda df: df.select(F.xxhash64(*schema.COLUMNS).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    a, b = key(rows), key(again).withColumnRenamed("n", "m")
    both = a.join(b, "h", "full")
    return both.agg(F.sum(F.coalesce("n", F.lit(0))).alias("rows_n"), F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0)))).alias("differing"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'))), chr(10)) AS emails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')""")
def emails(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(extraction.EMAIL), 0)))
    return table(spark, d, "documents").where(F.col("text").rlike(extraction.EMAIL)).select("doc_id", F.array_join(found, "\n").alias("emails"))


def _phone_sql(pattern: str, low: int, high: int) -> str:
    return rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS x FROM documents), n AS (SELECT DISTINCT doc_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS phone FROM m)
SELECT doc_id, phone FROM n WHERE length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN {low} AND {high}"""


def _phones(spark: SparkSession, d: str, pattern: str, low: int, high: int) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("x"))
    rows = rows.select("doc_id", F.trim(F.regexp_replace("x", r"\s+", " ")).alias("phone")).distinct()
    return rows.where(F.length(F.regexp_replace("phone", "[^0-9]", "")).between(low, high))


@query(_phone_sql(extraction.PHONE_INTERNATIONAL, 7, 15))
def phones_international(spark: SparkSession, d: str) -> DataFrame:
    return _phones(spark, d, extraction.PHONE_INTERNATIONAL, 7, 15)


@query(_phone_sql(extraction.PHONE_NATIONAL, 10, 11))
def phones_national(spark: SparkSession, d: str) -> DataFrame:
    return _phones(spark, d, extraction.PHONE_NATIONAL, 10, 11)


@query(r"""WITH s AS (SELECT DISTINCT site_id, regexp_extract(coalesce(visible_text_preview, ''), '(?i)(?:©|&copy;|\(c\)|Copyright|All rights reserved)[^\n]{0,120}', 0) AS c FROM sites) SELECT site_id, trim(regexp_replace(c, '\s+', ' ', 'g')) AS line FROM s WHERE c <> ''""")
def copyright_line(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sites").select("site_id", F.regexp_extract("visible_text_preview", extraction.COPYRIGHT, 0).alias("c")).where("c <> ''").distinct()
    return rows.select("site_id", F.trim(F.regexp_replace("c", r"\s+", " ")).alias("line"))


# Fetch log

_F = "WITH f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY fetch_id ORDER BY logged_at) AS rn FROM fetch_log) WHERE rn = 1)"


@query(f"{_F} SELECT fetch_status, count(*) AS n FROM f GROUP BY 1")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.status_histogram(table(spark, d, "fetch_log"))


@query(f"{_F} SELECT left(string_split(coalesce(fetch_error, ''), ';')[1], 80) AS error, count(*) AS n FROM f WHERE fetch_status <> 'ok' GROUP BY 1 ORDER BY n DESC, error LIMIT 10")
def error_topk(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.top_errors(table(spark, d, "fetch_log"))


@query(f"{_F} SELECT host AS domain, count(*) AS n FROM f WHERE host <> '' GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def domain_topk(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.top_domains(table(spark, d, "fetch_log"))


@query(f"""{_F}, t AS (SELECT timing, row_number() OVER (ORDER BY timing) - 1 AS i, count(*) OVER () AS n FROM f WHERE fetch_status = 'ok')
SELECT max(n) AS n, min(timing) AS min_ms, max(timing) FILTER (i = n // 2) AS median_ms, max(timing) FILTER (i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95_ms, max(timing) AS max_ms, round_even(sum(timing) / max(n), 1) AS mean_ms FROM t""")
def response_stats(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.response_times(table(spark, d, "fetch_log"))


@query(f"""{_F}, g AS (SELECT host, count(*) AS n_rows, count(*) FILTER (fetch_status = 'ok') AS n_ok FROM f GROUP BY host), r AS (SELECT *, round_even(100.0 * n_ok / n_rows, 1)::DOUBLE AS success_rate_percent FROM g)
SELECT *, CASE WHEN success_rate_percent >= 90 THEN 'excellent' WHEN success_rate_percent >= 75 THEN 'good' WHEN success_rate_percent >= 50 THEN 'fair' ELSE 'poor' END AS verdict FROM r""")
def success_rate_health(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.health(table(spark, d, "fetch_log"), ["host"])


@query(f"""{_F} SELECT proxy, count(*) AS done, count(*) FILTER (fetch_status = 'ok') AS ok, count(*) FILTER (fetch_status IS DISTINCT FROM 'ok') AS failed, CAST(sum(timing) AS BIGINT) AS total_ms, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS total_bytes,
arg_min(url, (fetched_at, fetch_id)) AS first_url, arg_max(url, (fetched_at, fetch_id)) AS last_url FROM f GROUP BY proxy""")
def worker_totals(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.worker_totals(table(spark, d, "fetch_log"))


@query(f"""{_F}, b AS (SELECT url, fetched_at, fetch_id FROM f WHERE fetch_status = 'robots_disallowed' ORDER BY fetched_at, fetch_id LIMIT 20)
SELECT CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries, count(*) FILTER (fetch_status = 'robots_disallowed') AS robots_blocked, (SELECT string_agg(url, chr(10) ORDER BY fetched_at, fetch_id) FROM b) AS blocked_sample FROM f""")
def network_totals(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.network_totals(table(spark, d, "fetch_log"))


@query(f"""{_F}, a AS (SELECT fetch_id, host, epoch_us(fetched_at) // 1000 AS arrival_ms, row_number() OVER (PARTITION BY host ORDER BY epoch_us(fetched_at) // 1000, fetch_id) - 1 AS rn FROM f WHERE host IS NOT NULL AND fetched_at IS NOT NULL)
SELECT fetch_id, host, arrival_ms, CAST(rn * 60000 + max(arrival_ms - rn * 60000) OVER (PARTITION BY host ORDER BY rn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slot_ms FROM a""")
def politeness_schedule(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.politeness_schedule(table(spark, d, "fetch_log"), 60_000)


@query(f"""{_F}, o AS (SELECT proxy, fetched_at, fetch_id, coalesce(http_status < 500, false) AS ok FROM f WHERE proxy IS NOT NULL), i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY proxy ORDER BY fetched_at, fetch_id ROWS UNBOUNDED PRECEDING) AS island FROM o),
r AS (SELECT proxy, island, count(*) AS length FROM i WHERE NOT ok GROUP BY 1, 2) SELECT p.proxy, coalesce(count(length), 0) AS runs, coalesce(max(length), 0) AS longest_run, count(*) FILTER (length >= 3) AS quarantines FROM (SELECT DISTINCT proxy FROM o) p LEFT JOIN r USING (proxy) GROUP BY p.proxy""")
def proxy_quarantines(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.proxy_quarantines(table(spark, d, "fetch_log"))


@query(f"{_F} SELECT fetch_id, 'http://p0' || ((row_number() OVER (ORDER BY fetched_at, fetch_id) - 1) % 7) || '.proxy.invalid:8080' AS proxy FROM f WHERE fetched_at IS NOT NULL")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.round_robin(table(spark, d, "fetch_log"), PROXIES)


@query(f"""{_F} SELECT fetch_id, CASE WHEN fetch_status = 'robots_disallowed' THEN 'robots_disallowed' WHEN fetch_status IN ('timeout','ssl_error','proxy_error','connection_error','redirect_loop') THEN fetch_status WHEN fetch_status = 'error' THEN 'error' WHEN http_status = 200 AND trim(coalesce(html, '')) = '' THEN 'empty_response'
WHEN http_status = 200 THEN 'ok' WHEN http_status IS NOT NULL THEN 'http_error' ELSE 'error' END AS outcome, coalesce(http_status IN (202, 429, 500, 502, 503, 504), false) OR coalesce(fetch_status IN ('timeout','connection_error','empty_response'), false) AS retried FROM f""")
def fetch_outcome(spark: SparkSession, d: str) -> DataFrame:
    marked = table(spark, d, "fetch_log").withColumn("body", F.when(F.trim(F.coalesce("html", F.lit(""))) == "", "").otherwise("x"))  # whether there's text is all that counts
    log = fetchlog.fetches(marked, ["http_status", "fetch_status", "body"])
    failed = F.when(F.col("fetch_status").isin("timeout", "ssl_error", "proxy_error", "connection_error", "redirect_loop", "error"), F.col("fetch_status"))
    out = fetchlog.outcome(F.col("http_status"), F.col("body"), failed, ~F.coalesce(F.col("fetch_status") == "robots_disallowed", F.lit(False)))
    return log.select("fetch_id", out.alias("outcome"), fetchlog.is_retried(F.col("http_status"), F.col("fetch_status")).alias("retried"))


@query("SELECT seq, url FROM url_list u WHERE NOT EXISTS (SELECT 1 FROM fetch_log f WHERE f.url = u.url)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.pending(table(spark, d, "url_list").select("seq", "url"), table(spark, d, "fetch_log"))


@query("SELECT seq, url FROM url_list u WHERE EXISTS (SELECT 1 FROM fetch_log f WHERE f.url = u.url)")
def resume_skipped(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.skipped(table(spark, d, "url_list").select("seq", "url"), table(spark, d, "fetch_log"))


@query()
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return fetchlog.run_summary(table(spark, d, "fetch_log"))


# Discovery

_LINKS = rf"""WITH RECURSIVE raw AS (SELECT url AS page, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<a href="([^"]+)"', 1)) AS h FROM pages WHERE html IS NOT NULL),
rel AS (SELECT page, replace(h, '&amp;', '&') AS h FROM raw WHERE NOT regexp_matches(h, '^(#|mailto:|tel:|javascript:|data:)')),
src AS (SELECT page, CASE WHEN regexp_matches(h, '^https?:') THEN h ELSE regexp_extract(page, '^(https?://[^/]*)', 1) || h END AS url FROM rel), {_CANON}"""


@query(_LINKS + " SELECT canonical AS dst, count(*) AS n FROM canon WHERE canonical <> '' GROUP BY 1")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return discover.link_table(spread(_pages(spark, d))).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


@query()
def link_graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    links = discover.checkpointed(discover.link_table(spread(pages)))
    return discover.breadth_first(links, pages.select("url", F.col("page_id").alias("place")), max_depth=2)


@query(_LINKS + r" SELECT count(*) FILTER (regexp_matches(canonical, '\.(jpg|png|pdf|zip|css|js)$')) AS skipped_extension, count(*) FILTER (NOT regexp_matches(host, '(^|\.)tolvanmarkt\.example$') AND NOT regexp_matches(canonical, '\.(jpg|png|pdf|zip|css|js)$')) AS skipped_scope, count(*) FILTER (regexp_matches(host, '(^|\.)tolvanmarkt\.example$') AND NOT regexp_matches(canonical, '\.(jpg|png|pdf|zip|css|js)$')) AS accepted FROM canon WHERE canonical <> ''")
def scope_counters(spark: SparkSession, d: str) -> DataFrame:
    return discover.scope_counters(discover.link_table(spread(_pages(spark, d))), ["tolvanmarkt.example"])


@query("SELECT page_id, url AS loc FROM pages")
def sitemap_locs(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("<urlset><url>\n<LOC> "), F.col("url"), F.lit(" </loc></url></urlset>"))
    return _pages(spark, d).select("page_id", F.explode(discover.sitemap_addresses(text)["pages"]).alias("loc"))


_ROBOTS = "User-agent: other\nDisallow: /\nUser-agent: *\nAllow: /p/1\nDisallow: /p/ # listings\nCrawl-delay: 1.5\nSitemap: https://a.example/s.xml"


@query(f"WITH t AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/]*([^#]*)', 1), ''), '/') AS p FROM pages) SELECT page_id, starts_with(p, '/p/1') OR NOT starts_with(p, '/p/') AS allowed, 1.5::DOUBLE AS crawl_delay FROM t")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    facts = discover.robots_facts(F.lit(_ROBOTS))
    rows = _pages(spark, d).withColumn("facts", facts)
    return rows.select("page_id", discover.robots_allowed(F.col("url"), F.col("facts.rules")).alias("allowed"), F.col("facts.crawl_delay"))


@query("""SELECT k AS "column", count(*) FILTER (regexp_matches(trim(v), '(?i)^(https?://|www\\.|[a-z0-9-]+\\.[a-z]{2,})')) AS hits, count(*) AS cells FROM (SELECT 'url' AS k, url AS v FROM pages UNION ALL SELECT 'html', html FROM pages UNION ALL SELECT 'page_id', CAST(page_id AS VARCHAR) FROM pages) GROUP BY k""")
def url_column_vote(spark: SparkSession, d: str) -> DataFrame:
    return vote_for_url_column(_pages(spark, d), ["page_id", "url", "html"])


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def pages_per_host(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(10)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
