import csv
import io
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions.packed import Packed
from webloom.operators import discover, fetchlog
from webloom.operators.eager_join import compact_states, heavy_keys, joined_states, rolled_up
from webloom.operators.packed_fields import packed_values


def items(text, links=False):
    return [(v.pos, v.item) for v in Packed(text, links).parse()]


def test_packed_forms():
    assert items('"a; b"; c|d / e\nf • g\th') == [(i + 1, x) for i, x in enumerate(["a; b", "c", "d", "e", "f", "g", "h"])]
    assert items('["x", "y \\"z\\"", "\\u00e9"]') == [(1, "x"), (2, 'y "z"'), (3, "é")]
    assert items('"the ""big"" set", , "12"" disc"') == [(1, 'the "big" set'), (2, '12" disc')]
    assert items("and/or, x") == [(1, "and/or"), (2, "x")]
    assert items("https://a/x https://a/y;v=2;https://a/z,https://a/q?x=1,2", True) == [(1, "https://a/x"), (2, "https://a/y;v=2"), (3, "https://a/z"), (4, "https://a/q?x=1,2")]
    assert items("") == items("  ") == items(";;") == []
    broken = list(Packed('"open, b').parse())
    assert [v.item for v in broken] == ['"open', "b"] and broken[0].error == "bad_quote"
    assert [v.item for v in Packed("x" * 100_000 + ",y").parse()] == ["x" * 100_000, "y"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ,;|\"'\n", min_size=1, max_size=8).filter(lambda s: s.strip() == s and s.strip()), min_size=1, max_size=6))
def test_quoted_values_come_back(values):
    text = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    assert [v for _, v in items(text)] == values


def test_packed_values_edges(spark):
    df = spark.createDataFrame([(1, "a,b", None, 9), (1, "a,b", None, 9), (2, None, "u v", 9), (None, "x", "y", 9)], "site_id bigint, k string, l string, pos int")
    got = sorted(map(tuple, packed_values(df, {"k": False, "l": True}).collect()))
    assert got == [(1, "k", 1, "a", ""), (1, "k", 2, "b", ""), (2, "l", 1, "u", ""), (2, "l", 2, "v", "")]
    assert packed_values(df.limit(0), {"k": False}).count() == 0


def test_eager_aggregation_equals_join(spark):
    r = random.Random(1)
    left = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randrange(5)) for _ in range(300)]
    right = [(r.choice(["hot"] * 5 + ["a", "c", None]), r.randrange(9)) for _ in range(200)]
    a, b = spark.createDataFrame(left, "k string, v int"), spark.createDataFrame(right, "k string, w int")
    plain = {x.k: (x.n, x.v, x.w) for x in a.join(b, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w")).collect()}
    states = joined_states(compact_states(a, ["k"], {"v": F.col("v")}), compact_states(b, ["k"], {"w": F.col("w")}), ["k"], ["v"], ["w"])
    assert {x.k: (x.n, x.v, x.w) for x in states.collect()} == plain
    assert rolled_up(states, [], ["v"]).first().n == sum(x[0] for x in plain.values())
    outer = joined_states(compact_states(a, ["k"]), compact_states(b, ["k"]), ["k"], how="left")
    assert sum(x.n for x in outer.collect()) == a.where("k IS NOT NULL").join(b, "k", "left").count()


def test_heavy_keys_edges(spark):
    rows = [(i, "hot") for i in range(50)] + [(i, "hot") for i in range(50)] + [(100 + i, f"d{i}") for i in range(48)] + [(900, None), (901, ""), (None, "hot")]
    df = spark.createDataFrame(rows, "id bigint, total string")
    assert [tuple(x) for x in heavy_keys(df, F.col("total"), F.col("id"), 0.02).collect()] == [("hot", 50, 100)]
    assert heavy_keys(df, F.col("total"), F.col("id"), 0.01).count() == 49
    assert heavy_keys(df.limit(0), F.col("total"), F.col("id"), 0.02).count() == 0


def log(spark, rows):
    return spark.createDataFrame(rows, "fetch_id bigint, host string, fetched_at timestamp, http_status int, fetch_status string, fetch_error string, timing bigint, proxy string, url string, html string, attempts int")


def test_politeness_and_quarantine_match_a_loop(spark):
    import datetime

    r = random.Random(3)
    start = datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC)
    rows = [(i, r.choice("ab"), start + datetime.timedelta(milliseconds=r.randrange(9_000_000)), r.choice([200, 200, 503, None]), "ok", "", 5, r.choice(["p", "q", None]), "u", "", 1) for i in range(400)]
    df = log(spark, rows + rows[:5])
    got = {x.fetch_id: x.slot_ms for x in fetchlog.politeness_schedule(df, 20_000).collect()}
    last, want = {}, {}
    for row in sorted(rows, key=lambda x: (int(x[2].timestamp() * 1000), x[0])):
        at = int(row[2].timestamp() * 1000)
        want[row[0]] = last[row[1]] = max(at, last.get(row[1], -(10**18)) + 20_000)
    assert got == want
    runs = {x.proxy: (x.longest_run, x.quarantines) for x in fetchlog.proxy_quarantines(df).collect()}
    for p in "pq":
        length, lengths = 0, []
        for row in sorted((x for x in rows if x[7] == p), key=lambda x: (x[2], x[0])):
            if (row[3] or 999) < 500:
                lengths, length = lengths + [length], 0
            else:
                length += 1
        lengths.append(length)
        assert runs[p] == (max(lengths), sum(n >= 3 for n in lengths))


def test_response_times_by_place(spark):
    rows = [(i, "h", None, 200, "ok", "", t, None, "u", "", 1) for i, t in enumerate([1, 2, 3, 4, 4, 4])]
    assert tuple(fetchlog.response_times(log(spark, rows)).first()) == (6, 1, 4, 4, 4, 3.0)
    empty = fetchlog.response_times(log(spark, [])).first()
    assert empty.n == 0 and empty.median_ms is None
    assert fetchlog.run_summary(log(spark, [])).first().health.verdict == "no_data"
    assert fetchlog.run_summary(log(spark, rows)).first().results.scraped_ok == 6


def test_walks(spark):
    edges = {"r": ["a", "b", "a"], "a": ["c", "x.png"], "b": ["c", "d"], "c": ["e"]}
    links = spark.createDataFrame([(f"https://t.test/{s}", i, f"https://t.test/{x}") for s, xs in edges.items() for i, x in enumerate(xs)], "src string, ord int, dst string")
    seeds = spark.createDataFrame([("https://t.test/r", 0)], "url string, place int")
    names = lambda df: [(r.url[-1], r.depth) for r in df.collect()]
    assert names(discover.breadth_first(links, seeds)) == [("r", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 2)]
    assert names(discover.breadth_first(links, seeds, max_urls=2)) == [("r", 0), ("a", 1)]
    assert names(discover.breadth_first(links, seeds, exclude="/a$")) == [("r", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert names(discover.breadth_first(links, seeds, include="zzz")) == []
    assert [u[-1] for u, _ in discover.depth_first(links, ["https://t.test/r"], 3)] == ["r", "b", "d", "c", "e", "a"]


def test_robots_and_sitemaps(spark):
    text = "User-agent: x\nDisallow: /\n\nUser-agent: *\nAllow: /p/1\nDisallow: /p/ # c\nCrawl-delay: 1.5\nSitemap: https://a/s.xml\nbroken"
    df = spark.createDataFrame([(u, text) for u in ("https://a/p/1", "https://a/p/2", "https://a/q")], "u string, t string")
    got = df.select(discover.robots_facts(F.col("t")).alias("f"), "u").select("u", "f.crawl_delay", "f.sitemaps", discover.robots_allowed(F.col("u"), F.col("f.rules")).alias("ok")).orderBy("u").collect()
    assert [r.ok for r in got] == [True, False, True] and got[0].crawl_delay == 1.5 and got[0].sitemaps == ["https://a/s.xml"]
    s = spark.createDataFrame([("<urlset><loc> a </loc><LOC>b</LOC>",), ("<SitemapIndex><loc>n</loc>",), ("junk",)], "t string").select(discover.sitemap_addresses(F.col("t")).alias("s")).collect()
    assert [(r.s.pages, r.s.nested) for r in s] == [(["a", "b"], []), ([], ["n"]), ([], [])]
