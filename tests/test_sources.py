import datetime
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from webloom import api, schema
from webloom.operators import audit
from webloom.operators.extract import extract
from webloom.operators.fetchlog import pending
from webloom.sources import http, sinks, url_lists
from webloom.sources.url_lists import read_proxies, read_urls
from webloom.streaming import pipeline


def page_rows(spark):
    pages = [("https://a.test/1", '<h1>Q "x"</h1><p>line one<p>two, three<a href="/b">b</a><a href="/c">c</a>'), ("https://a.test/2", None)]
    return extract(spark.createDataFrame(pages, "url string, html string")).cache()


@pytest.mark.parametrize("name", ["out.csv", "out.jsonl", "out.json", "out.db", "out.parquet"])
def test_formats_round_trip(spark, tmp_path, name):
    rows, path = page_rows(spark), str(tmp_path / name)
    sinks.write(rows, path)
    again = sinks.read(spark, path)
    assert sorted(map(str, again.select(*schema.COLUMNS).collect())) == sorted(map(str, rows.collect()))
    left = pending(spark.createDataFrame([("https://a.test/1",), ("https://a.test/9",)], "url string"), sinks.done_urls(spark, path))
    assert [r.url for r in left.collect()] == ["https://a.test/9"]


def test_formats_and_strictness(spark, tmp_path):
    assert [sinks.detect_format(f"x.{e}") for e in ("csv", "ndjson", "sqlite3", "json", "zzz")] == ["csv", "jsonl", "sqlite", "json", "csv"]
    with pytest.raises(ValueError):
        sinks.write(page_rows(spark), str(tmp_path / "x"), "nope")
    with pytest.raises(ValueError):
        schema.check_columns(spark.createDataFrame([("a",)], "zzz string"))
    (tmp_path / "torn.json").write_text('{"meta": {}, "sites": [\n{"url": "https://a/1", "h1_count": 2},\n{"url": "https://a/2", "h1_')
    assert [r.url for r in sinks.salvaged_json_lines(spark, str(tmp_path / "torn.json")).collect()] == ["https://a/1"]
    assert sinks.done_urls(spark, str(tmp_path / "none.csv")).count() == 0


@pytest.mark.parametrize(
    "name,text,want",
    [
        ("u.txt", "# c\nhttps://a.test\n\nb.test\nhttps://a.test\nnot one\n", ["https://a.test", "b.test"]),
        ("u.csv", "company,contact,Website\nx,y,a.test\nz,w,b.test\n", ["a.test", "b.test"]),
        ("h.csv", "1,https://a.test,x\n2,https://b.test,y\n", ["https://a.test", "https://b.test"]),
        ("t.tsv", "n\tu\n1\ta.test\n2\tb.test\n", ["a.test", "b.test"]),
        ("e.csv", "", []),
    ],
)
def test_url_lists(spark, tmp_path, name, text, want):
    (tmp_path / name).write_text(text)
    assert [r.url for r in read_urls(spark, str(tmp_path / name)).collect()] == want


def test_proxies(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a:1 # x\n#b\nsocks5://c:2\n")
    assert [r.proxy for r in read_proxies(spark, str(tmp_path / "p.txt")).orderBy("seq").collect()] == ["http://a:1", "socks5://c:2"]


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        code, body = (200, b"<h1>Heading</h1>") if self.path == "/" else (200, b" ") if self.path == "/blank" else (404, b"no")
        self.send_response(code)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_fetch_and_run(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        wanted = spark.createDataFrame([(base + p,) for p in ("/", "/blank", "/x")], "url string")
        got = {r.url[len(base) :]: (r.fetch_status, r.http_status, r.attempts) for r in http.fetch(wanted, retries=0).collect()}
        assert got == {"/": ("ok", 200, 1), "/blank": ("empty_response", 200, 1), "/x": ("http_error", 404, 1)}
        out = str(tmp_path / "o.jsonl")
        settings = api.load_settings(path=None, retries=0)
        assert {r.fetch_status: r.n for r in api.run(spark, wanted.limit(1), out, settings).collect()} == {"ok": 1}
        assert sum(r.n for r in api.run(spark, wanted, out, settings, resume=True).collect()) == 3
    finally:
        server.shutdown()
    assert http.get("http://127.0.0.1:1/", retries=1, wait=lambda s: None)["attempts"] == 2


class Ruled(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        Ruled.seen.append(self.path)
        pages = {"/robots.txt": "User-agent: *\nDisallow: /no\nCrawl-delay: 1\n", "/a": "<meta http-equiv='refresh' content='0; url=/b'>", "/b": "<meta http-equiv='refresh' content='0; url=/c'>", "/c": "<h1>End</h1>"}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(pages.get(self.path, "<h1>x</h1>").encode())

    def log_message(self, *a):
        pass


def test_fetch_keeps_robots_rules_and_follows_refreshes(spark):
    server = HTTPServer(("127.0.0.1", 0), Ruled)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        wanted = spark.createDataFrame([(base + p,) for p in ("/a", "/no/1", "/d")], "url string")
        start = time.monotonic()
        got = {r.url[len(base) :]: (r.fetch_status, r.final_url[len(base) :], r.http_status, r.robots_checked, r.attempts) for r in http.fetch(wanted, retries=0).collect()}
        assert got == {"/a": ("ok", "/c", 200, True, 1), "/no/1": ("robots_disallowed", "/no/1", None, True, 0), "/d": ("ok", "/d", 200, True, 1)}
        assert time.monotonic() - start >= 1 and "/no/1" not in Ruled.seen and Ruled.seen.count("/robots.txt") == 1
        pool = http.Proxies(["http://127.0.0.1:1", base])
        rows = [http.get("http://site.invalid/", retries=1, wait=lambda s: None, pool=pool) for _ in range(4)]
        assert {(r["fetch_status"], r["proxy"]) for r in rows} == {("ok", base)} and pool.failures == {"http://127.0.0.1:1": 3, base: 0}
    finally:
        server.shutdown()


class Linked(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        Linked.seen.append(self.path)
        base = f"http://127.0.0.1:{self.server.server_port}"
        pages = {
            "/robots.txt": "User-agent: *\nDisallow: /private\n", "/sitemap.xml": f"<sitemapindex><sitemap><loc>{base}/more.xml</loc></sitemap></sitemapindex>", "/more.xml": f"<urlset><url><loc>{base}/listed</loc></url></urlset>",
            "/": "<a href='/a'>a</a><a href='/a#x'>again</a><a href='/private/x'>p</a><a href='http://elsewhere.invalid/'>out</a><a href='/pic.png'>pic</a><a href='/data'>d</a>", "/a": "<a href='/b'>b</a><a href='/'>home</a>", "/b": "<a href='/c'>c</a>", "/data": "<a href='/hidden'>h</a>",
        }
        self.send_response(200 if self.path in pages else 404)
        self.send_header("Content-Type", "application/json" if self.path == "/data" else "text/html")
        self.end_headers()
        self.wfile.write(pages.get(self.path, "none").encode())

    def log_message(self, *a):
        pass


def test_crawl(spark):
    server = HTTPServer(("127.0.0.1", 0), Linked)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        got = {(r.url[len(base) :], r.depth, r.fetch_status) for r in api.discover(spark, [base + "/"], api.load_settings(retries=0, max_depth=2)).collect()}
        assert got == {("/", 0, "ok"), ("/a", 1, "ok"), ("/data", 1, "ok"), ("/private/x", 1, "robots_disallowed"), ("/b", 2, "ok")}
        assert "/private/x" not in Linked.seen and "/pic.png" not in Linked.seen
        got = {r.url[len(base) :] for r in api.discover(spark, [base + "/"], api.load_settings(retries=0, max_depth=0), from_sitemaps=True).collect()}
        assert got == {"/", "/listed"}
        assert api.discover(spark, [base + "/"], api.load_settings(retries=0, max_depth=2, max_urls=3)).count() == 3
    finally:
        server.shutdown()


def test_json_resume_keeps_what_is_there(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, out = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "o.json")
    wanted = lambda *paths: spark.createDataFrame([(base + p,) for p in paths], "url string")
    try:
        api.run(spark, wanted("/", "/x"), out, api.load_settings(retries=0))
        api.run(spark, wanted("/", "/x", "/blank"), out, api.load_settings(retries=0), resume=True)
        assert sorted(r.url[len(base) :] for r in sinks.read(spark, out).collect()) == ["/", "/blank", "/x"]
    finally:
        server.shutdown()


def test_csv_file_is_mended(spark, tmp_path):
    rows, path = page_rows(spark), str(tmp_path / "one.csv")
    assert sinks.write_csv_file(rows, path) == 2
    data = open(path, "rb").read()
    assert data.startswith(b"\xef\xbb\xbfurl,") and data.count(b"\r\n") >= 3
    with open(path, "ab") as f:
        f.write(b'https://a.test/torn,"half\n of a')
    sinks.write_csv_file(rows.limit(1), path, append=True)
    again = sinks.read_csv(spark, path)
    assert again.count() == 3 and again.where("url LIKE '%torn%'").count() == 0
    assert sinks.rebuilt_json_document(spark, path, str(tmp_path / "r.json")) == 3 == sinks.whole_rows(spark, str(tmp_path / "r.json"))
    assert sinks.reconciled(again, rows).count() == 0 and [r.url for r in sinks.reconciled(again, rows.where("url LIKE '%2'")).collect()] == ["https://a.test/1"]
    sinks.write_json_lines(rows, str(tmp_path / "m.jsonl"), meta={"run": 1})
    assert spark.read.text(str(tmp_path / "m.jsonl")).where("value LIKE '{\"_meta\"%'").count() == 1 and sinks.read_json_lines(spark, str(tmp_path / "m.jsonl")).count() == 2


def test_more_lists_and_widths(spark, tmp_path):
    (tmp_path / "f.csv").write_text("URL,x\nhttps://a.test,1\n,2\n\"b.test\",3\n")
    assert [r.url for r in url_lists.first_column(spark, str(tmp_path / "f.csv")).orderBy("seq").collect()] == ["https://a.test", "b.test"]
    assert [r.url for r in url_lists.urls_of_stream(spark, ["# c\n", "a.test\n", "\n", "b.test"]).orderBy("seq").collect()] == ["a.test", "b.test"]
    cells = spark.createDataFrame([(["x"] * 90,), (["x"] * 89,), (["x"] * 89 + [None],)], "cells array<string>")
    assert {(r.row_columns, r.n) for r in audit.width_faults(cells).collect()} == {(89, 1), (-1, 1)}


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "webloom.toml").write_text("[network]\ntimeout = 5\nretries = 'bad'\n")
    monkeypatch.setenv("WEBLOOM_DELAY", "0.5")
    s = api.load_settings(tmp_path / "webloom.toml", max_depth=4)
    assert (s.timeout, s.retries, s.delay, s.max_depth) == (5.0, 2, 0.5, 4)


def test_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC)
    rows = [(i, f"https://a.test/{i}", f"<h1>{i}</h1>", "ok", t) for i in range(5)]
    df = spark.createDataFrame(rows + rows[:2], "fetch_id bigint, url string, html string, fetch_status string, fetched_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = pipeline.deduplicated(pipeline.fetch_stream(spark, str(tmp_path / "in"), df.schema))
    pipeline.write_pages(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = extract(df.dropDuplicates(["fetch_id"]), ("fetch_id",))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    pipeline.write_pages(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
