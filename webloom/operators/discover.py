"""Discovery of pages: link tables, scope, robots rules, sitemaps and walks of the link graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators.parse import parse_page
from webloom.operators.sized import checkpointed


def first_seen(df: DataFrame, key: Column, order: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., key, order)``: the least ``order`` of each key; NULL and empty keys are left out.  Keeps order explicit."""
    rows = df.select(*by, key.alias("key"), F.col(order)).where(F.col("key") != "")
    return rows.groupBy(*by, "key").agg(F.min(order).alias(order))


def link_table(pages: DataFrame) -> DataFrame:
    """``(src, ord, dst)`` with canonical addresses: the anchors of each page in document order."""
    parsed = pages.where(F.col("html").isNotNull()).select(F.col("url"), parse_page(F.col("html"), F.col("url")).alias("p"))
    anchors = parsed.select(urls.canonicalize(F.col("url")).alias("src"), F.posexplode(F.filter("p.anchors", lambda a: a["url"].isNotNull() & ~a["href"].rlike("^(?:#|mailto:|tel:|javascript:|data:)"))).alias("ord", "a"))
    links = anchors.select("src", "ord", urls.canonicalize(F.col("a.url")).alias("dst"))
    return links.where("src <> '' AND dst <> ''")


def scope_counters(links: DataFrame, allowed: Sequence[str], exact_hosts: bool = False) -> DataFrame:
    """One row: link occurrences by extension, scope and acceptance, each tested in this order."""
    skip, inside = urls.has_skip_extension(F.col("dst")), urls.same_scope(F.col("dst"), allowed, exact_hosts)
    return links.agg(F.count_if(skip).alias("skipped_extension"), F.count_if(~skip & ~inside).alias("skipped_scope"), F.count_if(~skip & inside).alias("accepted"))


def breadth_first(links: DataFrame, seeds: DataFrame, max_depth: int = 2, max_urls: int | None = None, include: str | None = None, exclude: str | None = None, allowed: Sequence[str] | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """``(url, depth, place)``: pages in the order of a breadth-first crawl from ``seeds`` ``(url, place)``.

    A page's place is that of its first mention: the place of the page that names it and the number of the link there.  A page that
    ``include`` doesn't match or ``exclude`` does, or that stands in ``blocked`` ``(url)``, isn't listed nor followed, seeds included.
    One join a level; a level is checkpointed, so that lineage doesn't grow.
    """

    def passes(df: DataFrame) -> DataFrame:
        if include:
            df = df.where(F.col("url").rlike("(?i)" + include))
        if exclude:
            df = df.where(~F.col("url").rlike("(?i)" + exclude))
        return df.join(blocked.select("url").distinct(), "url", "left_anti") if blocked is not None else df

    usable = links.where(~urls.has_skip_extension(F.col("dst")))
    if allowed is not None:
        usable = usable.where(urls.same_scope(F.col("dst"), allowed))
    start = seeds.select(urls.canonicalize(F.col("url")).alias("url"), F.array(F.col("place").cast("bigint")).alias("place")).where("url <> ''")
    level = checkpointed(start.groupBy("url").agg(F.min("place").alias("place")))
    seen, out = level.select("url"), passes(level).withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        named = usable.join(passes(level).select(F.col("url").alias("src"), "place"), "src").select(F.col("dst").alias("url"), F.concat("place", F.array(F.col("ord").cast("bigint"))).alias("place"))
        level = checkpointed(named.groupBy("url").agg(F.min("place").alias("place")).join(seen, "url", "left_anti"))
        out = out.unionByName(passes(level).withColumn("depth", F.lit(depth)))
        if depth < max_depth:
            seen = checkpointed(seen.unionByName(level.select("url")))
    ordered = out.select("url", "depth", F.array_join("place", ".").alias("place"), F.col("place").alias("_key")).orderBy("depth", "_key")
    return (ordered.limit(max_urls) if max_urls else ordered).drop("_key")


def depth_first(links: DataFrame, seeds: Sequence[str], max_depth: int = 2, max_urls: int = 1000, most_links: int = 1_000_000) -> list[tuple[str, int]]:
    """``(url, depth)`` in the order of a crawl that takes the newest page first.

    The order depends on each step before it, so it's walked on the driver over the links within ``max_depth`` of the seeds; more than
    ``most_links`` of them raise.
    """
    spark = links.sparkSession
    links = links.where(~urls.has_skip_extension(F.col("dst")))
    near = breadth_first(links, spark.createDataFrame([(u, i) for i, u in enumerate(seeds)], "url string, place int"), max_depth)
    rows = links.join(near.select(F.col("url").alias("src")), "src", "left_semi").limit(most_links + 1).collect()
    if len(rows) > most_links:
        raise ValueError(f"more than {most_links} links")
    named: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.src, r.ord)):
        named.setdefault(r.src, []).append(r.dst)
    start = [r.u for r in spark.createDataFrame([(u,) for u in seeds], "u string").select(urls.canonicalize(F.col("u")).alias("u")).collect() if r.u]
    stack, seen, out = [(u, 0) for u in dict.fromkeys(start)], set(start), []
    while stack and len(out) < max_urls:
        url, depth = stack.pop()
        out.append((url, depth))
        for dst in named.get(url, []) if depth < max_depth else []:
            if dst not in seen:
                seen.add(dst)
                stack.append((dst, depth + 1))
    return out


def sitemap_addresses(text: Column) -> Column:
    """``struct<pages, nested>`` of a sitemap; tolerant of broken XML."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda x: F.trim(x)), lambda x: x != "")
    index = F.contains(F.lower(F.left(text, F.lit(2000))), F.lit("<sitemapindex"))
    none = F.array().cast("array<string>")
    return F.struct(F.when(index, none).otherwise(found).alias("pages"), F.when(index, found).otherwise(none).alias("nested"))


def robots_facts(text: Column, agent: str = "*") -> Column:
    """Rules for every agent or ``agent``, sitemaps and delay of a robots file; a user-agent line replaces the agent before it."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(F.substring_index(x, "#", 1)))
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.named_struct(F.lit("k"), F.lower(F.trim(F.substring_index(x, ":", 1))), F.lit("v"), F.trim(F.regexp_replace(x, "^[^:]*:", ""))))
    none = F.array().cast("array<string>")
    zero = F.struct(F.lit("").alias("agent"), none.alias("disallow"), none.alias("allow"), none.alias("sitemaps"), F.array().cast("array<struct<allow:boolean,prefix:string>>").alias("rules"), F.lit(None).cast("double").alias("delay"))

    def step(state: Column, p: Column) -> Column:
        mine, given = state["agent"].isin("*", agent.lower()), p["v"] != ""
        more = lambda name, test: F.when(test & given, F.concat(state[name], F.array(p["v"]))).otherwise(state[name]).alias(name)
        return F.struct(
            F.when(p["k"] == "user-agent", F.lower(p["v"])).otherwise(state["agent"]).alias("agent"), more("disallow", (p["k"] == "disallow") & mine), more("allow", (p["k"] == "allow") & mine), more("sitemaps", p["k"] == "sitemap"),
            F.when(p["k"].isin("allow", "disallow") & mine & given, F.concat(state["rules"], F.array(F.struct((p["k"] == "allow").alias("allow"), p["v"].alias("prefix"))))).otherwise(state["rules"]).alias("rules"),
            F.when(p["k"] == "crawl-delay", F.coalesce(p["v"].try_cast("double"), state["delay"])).otherwise(state["delay"]).alias("delay"),
        )

    facts = F.aggregate(pairs, zero, step)
    return F.struct(F.slice(facts["disallow"], 1, 50).alias("disallow"), F.slice(facts["allow"], 1, 50).alias("allow"), F.slice(facts["sitemaps"], 1, 20).alias("sitemaps"), facts["rules"].alias("rules"), facts["delay"].alias("crawl_delay"))


def robots_allowed(url: Column, rules: Column) -> Column:
    """Whether ``rules`` of ``robots_facts`` let ``url`` be fetched: the first rule whose prefix matches decides; no rules allow everything."""
    target = F.concat(F.when(urls.url_part(url, 3) == "", "/").otherwise(urls.url_part(url, 3)), F.when(urls.url_part(url, 4) != "", F.concat(F.lit("?"), urls.url_part(url, 4))).otherwise(""))
    first = F.get(F.filter(rules, lambda r: F.startswith(target, r["prefix"])), F.lit(0))
    return F.coalesce(first["allow"], F.lit(True))
