"""What a user calls: extract, discover, run and audit on DataFrames, and layered settings."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import audit, fetchlog
from webloom.operators.discover import breadth_first, link_table, sitemap_addresses
from webloom.operators.extract import extract
from webloom.operators.sized import checkpointed
from webloom.sources import http, sinks
from webloom.sources.url_lists import read_proxies, read_urls


@dataclass(frozen=True)
class Settings:
    timeout: float = 20.0
    retries: int = 2
    delay: float = 0.0
    max_response_bytes: int = 4 << 20
    user_agent: str = "webloom"
    max_depth: int = 2
    max_urls: int = 1000
    retry_failed: bool = False
    robots: bool = True
    proxy_file: str = ""
    format: str = ""


def find_settings(start: str = ".", name: str = "webloom.toml", levels: int = 12) -> Path | None:
    """The nearest settings file of a folder or of those above it."""
    at = Path(start).resolve()
    return next((p / name for p in [at, *at.parents][:levels] if (p / name).is_file()), None)


def load_settings(path: str | Path | None = None, **given) -> Settings:
    """Defaults, then a TOML file, then ``WEBLOOM_...`` variables, then arguments; values that don't fit are passed over."""
    settings, kinds = Settings(), {f.name: type(f.default) for f in fields(Settings)}
    layers: list[dict] = []
    path = path or find_settings()
    if path:
        with open(path, "rb") as f:
            loaded = tomllib.load(f)
        layers.append({k: v for section in (loaded, *[x for x in loaded.values() if isinstance(x, dict)]) for k, v in section.items()})
    layers += [{k: os.environ[f"WEBLOOM_{k.upper()}"] for k in kinds if f"WEBLOOM_{k.upper()}" in os.environ}, {k: v for k, v in given.items() if v is not None}]
    for layer in layers:
        for k, v in layer.items():
            if k in kinds:
                try:
                    value = str(v).lower() in ("1", "true", "yes", "on") if kinds[k] is bool else kinds[k](v)
                    settings = replace(settings, **{k: value})
                except (TypeError, ValueError):
                    continue
    return settings


def run(spark: SparkSession, source: str | DataFrame, output: str, settings: Settings | None = None, resume: bool = False) -> DataFrame:
    """Fetch a list of addresses, extract their rows, write them and give the summary's health by status.

    With ``resume`` addresses that ``output`` holds already are left out and the rest is appended; a JSON document is written anew with the rows of both.
    """
    s = settings or load_settings()
    wanted = read_urls(spark, source) if isinstance(source, str) else source
    if resume:
        wanted = fetchlog.pending(wanted, sinks.done_urls(spark, output, s.format or None), retry_failed=s.retry_failed)
    proxies = [r.proxy for r in read_proxies(spark, s.proxy_file).orderBy("seq").collect()] if s.proxy_file else []
    fetched = http.fetch(wanted, s.delay, s.robots, proxies, timeout=s.timeout, retries=s.retries, most_bytes=s.max_response_bytes, agent=s.user_agent)
    rows = extract(fetched)
    name = s.format or sinks.detect_format(output)
    if name == "json" and resume and sinks.exists(spark, output):  # a document is written whole: what it holds already goes first
        rows = sinks.read_json_document(spark, output).unionByName(rows)
    sinks.write(rows, output, name, **({"mode": "append" if resume else "errorifexists"} if name in ("csv", "jsonl", "parquet") else {}))
    return audit.audit_histogram(sinks.read(spark, output, name))


def _responses(fetched: DataFrame) -> DataFrame:
    """``(url, html)`` of what may hold links: status 200 and, where the header says what it is, HTML."""
    kind = F.lower(F.coalesce(F.element_at("headers", "Content-Type"), F.element_at("headers", "content-type"), F.lit("text/html")))
    return fetched.where((F.col("http_status") == 200) & kind.contains("html") & (F.col("html") != "")).select(F.col("final_url").alias("url"), "html")


def crawl(spark: SparkSession, seeds: DataFrame | list[str], settings: Settings | None = None, from_sitemaps: bool = False, **options) -> DataFrame:
    """Fetched pages and their ``depth``, from ``seeds`` along links within the seeds' domains, level by level up to ``max_depth``.

    Each address is fetched once, under its canonical form; robots files and delays are kept to; at most ``max_urls`` addresses are taken, a level's
    by their order.  With ``from_sitemaps`` the addresses of the seeds' sitemaps join the first level.  Levels are checkpointed.
    """
    s = settings or load_settings()
    if not isinstance(seeds, DataFrame):
        seeds = spark.createDataFrame([(u,) for u in seeds], "url string")
    options = {"timeout": s.timeout, "retries": s.retries, "most_bytes": s.max_response_bytes, "agent": s.user_agent} | options
    domain = urls.registrable_domain(urls.host(F.col("url")))
    level = seeds.select(urls.canonicalize(F.col("url")).alias("url")).where("url <> ''").distinct()
    scope = checkpointed(level.select(domain.alias("domain")).distinct())
    if from_sitemaps:
        origins = level.select(F.concat(urls.origin(F.col("url")), F.lit("/sitemap.xml")).alias("url")).distinct()
        listed = sitemap_pages(origins, **options).select(urls.canonicalize(F.col("url")).alias("url")).where("url <> ''")
        level = level.unionByName(listed.withColumn("domain", domain).join(scope, "domain", "left_semi").select("url")).distinct()
    level = checkpointed(level.orderBy("url").limit(s.max_urls))
    seen, out, left = level, None, s.max_urls - level.count()
    for depth in range(s.max_depth + 1):
        fetched = checkpointed(http.fetch(level, s.delay, s.robots, **options).withColumn("depth", F.lit(depth)))
        out = fetched if out is None else out.unionByName(fetched)
        if depth == s.max_depth or left <= 0:
            break
        found = link_table(_responses(fetched)).select(F.col("dst").alias("url")).where(~urls.has_skip_extension(F.col("dst"))).distinct()
        found = found.withColumn("domain", domain).join(scope, "domain", "left_semi").select("url").join(seen, "url", "left_anti")
        level = checkpointed(found.orderBy("url").limit(left))
        n = level.count()
        if not n:
            break
        left, seen = left - n, checkpointed(seen.unionByName(level))
    return out


def discover(spark: SparkSession, seeds: DataFrame | list[str], settings: Settings | None = None, **options) -> DataFrame:
    """``(url, depth, fetch_status)`` of what ``crawl`` visits."""
    return crawl(spark, seeds, settings, **options).select("url", "depth", "fetch_status")


def sitemap_pages(addresses: DataFrame, most_levels: int = 3, **options) -> DataFrame:
    """``(url)``: the pages that sitemaps list, with those of the sitemaps that they name, ``most_levels`` deep; each sitemap is read once."""
    level, seen, pages = addresses.select("url").distinct(), None, None
    for _ in range(most_levels):
        fetched = http.fetch(level, robots=False, **options).where("http_status = 200").select(sitemap_addresses(F.col("html")).alias("x"))
        fetched = checkpointed(fetched.select("x.pages", "x.nested"))
        found = fetched.select(F.explode("pages").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        seen = level if seen is None else seen.unionByName(level)
        level = checkpointed(fetched.select(F.explode("nested").alias("url")).distinct().join(seen, "url", "left_anti"))
        if not level.limit(1).count():
            break
    return pages.distinct()


__all__ = ["crawl", "discover", "sitemap_pages", "Settings", "breadth_first", "extract", "find_settings", "link_table", "load_settings", "run"]
