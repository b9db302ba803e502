"""URL algebra as Column expressions: foldable, pushable, without a Python hop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "utm_referrer", "utm_social", "gclid", "fbclid", "msclkid", "dclid", "yclid",
    "twclid", "igshid", "mc_cid", "mc_eid", "_ga", "_gl", "ref_src", "ref_url", "sessionid", "session_id", "phpsessid", "jsessionid", "aspsessionid",
]
SKIP_EXTENSIONS = (
    ".jpg .jpeg .png .gif .webp .svg .ico .bmp .tif .css .js .mjs .json .xml .rss .atom .pdf .doc .docx .xls .xlsx .ppt .pptx .zip .tar .gz .bz2 .7z .rar .exe .dmg .pkg "
    ".mp3 .mp4 .avi .mov .wmv .flv .webm .ogg .wav .woff .woff2 .ttf .eot .otf .csv .sql .db .log .map"
).split()
DOCUMENT_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".tsv", ".zip", ".rar", ".7z", ".gz", ".tar", ".rtf", ".odt", ".ods", ".odp", ".epub"]
MEDIA_EXTENSIONS = [".mp4", ".webm", ".ogg", ".ogv", ".mov", ".avi", ".mkv", ".m4v", ".mp3", ".wav", ".flac", ".aac", ".m4a", ".oga"]
MEDIA_HOSTS = ["youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "wistia.com", "soundcloud.com", "spotify.com"]
SOCIAL_HOSTS = {
    "facebook.com": "facebook_url", "linkedin.com": "linkedin_url", "instagram.com": "instagram_url", "youtube.com": "youtube_url", "youtu.be": "youtube_url", "github.com": "github_url",
    "twitter.com": None, "x.com": None, "t.me": None, "tiktok.com": None, "pinterest.com": None, "medium.com": None, "threads.net": None, "wa.me": None, "whatsapp.com": None, "discord.gg": None, "discord.com": None,
}
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go", "in", "info", "biz", "mil", "sch"]
NO_BRAND = ["www", "www1", "www2", "m", "mobile", "docs", "blog", "en", "de", "es", "fr", "ja", "zh", "ru", "pt", "tr", "uk", "xen"]
OTHER_SCHEMES = ["mailto:", "tel:", "javascript:", "data:", "ftp:", "file:", "sms:", "callto:", "whatsapp:", "skype:"]

_URL = r"^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_LOOKS = r"(?i)^(https?://|www\.|[a-z0-9-]+\.[a-z]{2,})"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85 ]+|[\s\x1c-\x1f\x85 ]+$", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it's used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_url(url: Column) -> Column:
    """Trimmed, with ``https://`` where there's no ``http(s)://``; NULL stays NULL."""
    u = _strip(url)
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def looks_like_url(text: Column) -> Column:
    return F.coalesce(text.rlike(_LOOKS), F.lit(False))


def url_part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment of an absolute http(s) URL; ``''`` if there is none."""
    return F.regexp_extract(url, "(?i)" + _URL, group)


def host(url: Column) -> Column:
    """Lower-cased host name, without user and port; ``''`` for what isn't a http(s) URL."""
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))


def origin(url: Column) -> Column:
    return F.when(url_part(url, 2) == "", "").otherwise(F.concat(F.lower(url_part(url, 1)), F.lit("://"), url_part(url, 2)))


def is_https(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https:"), F.lit(False))


def _decoded(piece: Column) -> Column:
    return F.coalesce(F.try_url_decode(piece), F.replace(piece, F.lit("+"), F.lit(" ")))


def _encoded(piece: Column) -> Column:
    return F.replace(F.replace(F.url_encode(piece), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.named_struct(F.lit("k"), _decoded(F.substring_index(p, "=", 1)), F.lit("v"), _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING_PARAMS))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def canonicalize(url: Column, drop_tracking: bool = True, drop_fragment: bool = True) -> Column:
    """Canonical form for comparing addresses, ``''`` for what is no web address or has an impossible port.

    Scheme and host in lower case, no user, default port, doubled or trailing slash, tracking parameter or fragment;
    parameters sorted and encoded anew.  NULL gives ``''``.
    """
    return _let(_strip(F.coalesce(url, F.lit(""))), lambda u: _let(F.lower(u), lambda low: _canonical(u, low, drop_tracking, drop_fragment)))


def _canonical(u: Column, low: Column, drop_tracking: bool, drop_fragment: bool) -> Column:
    web = low.rlike("^https?://")
    other = low.rlike("^(?:" + "|".join(OTHER_SCHEMES) + ")")

    def assembled(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
        name = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))
        port = F.regexp_extract(authority, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
        number = port.try_cast("int")
        bad_port = (port != "") & (number.isNull() | (number < 0) | (number > 65535) | ~port.rlike("^[0-9]+$"))
        shown = F.when((port == "") | (number == 0) | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443)), name).otherwise(F.concat(name, F.lit(":"), number.cast("string")))
        clean = _let(F.regexp_replace(path, "/{2,}", "/"), lambda p: F.when(p == "", "/").when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p))
        asked = F.when(query == "", "").otherwise(_let(_clean_query(query) if drop_tracking else query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))
        parts = [scheme, F.lit("://"), shown, clean, asked]
        if not drop_fragment:
            parts.append(F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
        return F.when((name == "") | bad_port, "").otherwise(F.concat(*parts))

    full = F.when(web, u).otherwise(F.concat(F.lit("https://"), u))
    split = _let(full, lambda f: F.array(F.lower(url_part(f, 1)), F.regexp_replace(url_part(f, 2), "^.*@", ""), url_part(f, 3), url_part(f, 4), url_part(f, 5)))
    whole = _let(split, lambda p: assembled(p[0], p[1], p[2], p[3], p[4]))
    return F.when((u == "") | other | (F.contains(u, F.lit("://")) & ~web), "").otherwise(whole)


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host, three where the second-last is a common public suffix of a country; addresses unchanged."""
    h = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^\.+|\.+$", "")

    def last(labels: Column) -> Column:
        country = F.element_at(labels, -2).isin(SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
        number = (F.size(labels) == 4) & F.forall(labels, lambda x: x.rlike("^[0-9]+$"))
        return F.when((F.size(labels) <= 2) | number, F.array_join(labels, ".")).when(country, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))

    return _let(F.split(h, r"\."), last)


def has_skip_extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(url_part(url, 3)), r"(\.[^.]*)$", 1).isin(SKIP_EXTENSIONS)


def path_ends_with(url: Column, extensions: Sequence[str]) -> Column:
    return F.lower(url_part(url, 3)).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")


def is_document(url: Column) -> Column:
    return path_ends_with(url, DOCUMENT_EXTENSIONS)


def host_is(name: Column, hosts: Sequence[str]) -> Column:
    """The host or a subdomain of one of ``hosts``."""
    return name.rlike(r"(?:^|\.)(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + ")$")


def is_media(url: Column) -> Column:
    return path_ends_with(url, MEDIA_EXTENSIONS) | host_is(host(url), MEDIA_HOSTS)


def is_external(url: Column, base_host: Column) -> Column:
    h = host(url)
    return (h != "") & (base_host != "") & (h != base_host) & ~F.endswith(h, F.concat(F.lit("."), base_host))


def same_scope(url: Column, allowed: Sequence[str], exact_hosts: bool = False) -> Column:
    name = host(url)
    return (name if exact_hosts else registrable_domain(name)).isin(list(allowed))


def brand_from_domain(domain: Column) -> Column:
    """A host without leading service labels and its last label, capitalised; of what is left empty the first label."""
    labels = F.filter(F.split(F.lower(domain), r"\."), lambda x: x != "")
    # Labels from the first that isn't a service name on.
    kept = F.filter(labels, lambda x, i: F.exists(F.slice(labels, 1, i + 1), lambda y: ~y.isin(NO_BRAND)))
    body = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    words = F.when(F.size(body) > 0, body).otherwise(F.array(F.substring_index(domain, ".", 1)))
    capital = F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
    return F.when(F.coalesce(domain, F.lit("")) == "", "").otherwise(F.array_join(capital, " "))


META_REFRESH = r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]+content=["']\s*\d+\s*;\s*url\s*=\s*["']?([^"'>\s]+)"""


def meta_refresh_target(html: Column) -> Column:
    """The address that a page's refresh names, not yet resolved; ``''`` if there is none."""
    return F.trim(F.coalesce(F.regexp_extract(html, META_REFRESH, 1), F.lit("")))


def register(spark) -> None:
    """``canonical_url``, ``registrable_domain`` and ``url_host`` as SQL functions; temporary, for this session."""
    for name, body in {"canonical_url": canonicalize(F.col("u")), "registrable_domain": registrable_domain(F.col("u")), "url_host": host(F.col("u"))}.items():
        sql = spark.createDataFrame([], "u string").select(body.alias("x"))._jdf.queryExecution().analyzed().expressions().head().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(u STRING) RETURNS STRING RETURN {sql.rpartition(' AS ')[0]}")
