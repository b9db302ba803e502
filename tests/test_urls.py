import pytest
from pyspark.sql import functions as F

from webloom.functions import urls

CANONICAL = {
    "example.com": "https://example.com/", "HTTPS://Example.COM/Path": "https://example.com/Path", "http://a.test:80/x": "http://a.test/x", "https://a.test:443/": "https://a.test/", "http://a.test:8080/x": "http://a.test:8080/x",
    "https://a.test/a/b/": "https://a.test/a/b", "https://a.test/a//b///c": "https://a.test/a/b/c", "https://a.test/x#sec": "https://a.test/x", "https://a.test/?utm_source=x&b=2&a=1&fbclid=zz": "https://a.test/?a=1&b=2",
    "https://a.test/?page=3": "https://a.test/?page=3", "mailto:a@b.c": "", "javascript:void(0)": "", "ftp://a.test/": "", "": "", "   ": "", None: "", "https://user:pw@A.test/": "https://a.test/", "https://a.test:99999/": "", "https://a.test:x/": "",
    "https://a.test/?q=a%20b+c&k": "https://a.test/?k=&q=a+b+c", "https://a.test/?z=%zz": "https://a.test/?z=%25zz",
}


def one(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r.x for r in df.select("i", expression(F.col("u")).alias("x")).orderBy("i").collect()]


def test_canonicalize(spark):
    assert dict(zip(CANONICAL, one(spark, list(CANONICAL), urls.canonicalize), strict=True)) == CANONICAL


def test_canonicalize_is_idempotent(spark):
    once = one(spark, list(CANONICAL), urls.canonicalize)
    assert one(spark, once, urls.canonicalize) == once


@pytest.mark.parametrize("host,domain", [("www.example.com", "example.com"), ("www.example.co.uk", "example.co.uk"), ("www.foo.com.pk", "foo.com.pk"), ("example.com", "example.com"), ("192.168.1.1", "192.168.1.1"), ("a.b.c.example.com", "example.com"), (None, ""), ("localhost", "localhost")])
def test_registrable_domain(spark, host, domain):
    assert one(spark, [host], urls.registrable_domain) == [domain]


def test_scalars(spark):
    assert one(spark, ["example.com", " http://a ", None], urls.normalize_url) == ["https://example.com", "http://a", None]
    assert one(spark, ["https://a/x.PNG", "https://a/", "https://a/b.html", "https://a.png/"], urls.has_skip_extension) == [True, False, False, False]
    assert one(spark, ["www.postgres.org", "docs.python.org", "", "m.test"], urls.brand_from_domain) == ["Postgres", "Python", "", "M"]
    assert one(spark, ["a.test", "https://x", "hello", None], urls.looks_like_url) == [True, True, False, False]
    assert one(spark, ['<meta http-equiv="refresh" content="0; url=/new">', "", None], urls.meta_refresh_target) == ["/new", "", ""]
    assert one(spark, ["https://a.b.test/x", "https://c.test"], lambda u: urls.same_scope(u, ["b.test"])) == [True, False]
