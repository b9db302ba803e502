from webloom import schema
from webloom.functions import dom
from webloom.operators import audit, parse
from webloom.operators.extract import extract

SAMPLE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Shop — lamps
 and more</title><meta name="description" content="We sell lamps"><meta name="DESCRIPTION" content="second"><meta property="og:site_name" content="Lamp Shop"><meta property="og:image" content="/logo.png"><meta name="twitter:site" content="lamps">
<meta name="generator" content="WordPress, some release"><link rel="canonical" href="https://shop.test/"><link rel="shortcut icon" href="/fav.ico"><link rel="stylesheet" href="/s.css"><link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="alternate" hreflang="de" href="/de">
<script type="application/ld+json">{"@type": ["Organization"], "name": "Lamps Ltd", "foundingDate": 2012, "telephone": "+1-555-0100", "address": {"addressLocality": "Austin", "postalCode": "1"}, "contact": {"deep": [{"email": "mailto:ld@shop.test"}]}}</script></head>
<body><nav><a href="/a">A</a><a href="/a#top">A again</a></nav><ul><li><h1>Brass <div>x</div> Lamps</h1></ul><h2 class="hidden">no</h2><p class="never-hidden-here">Write to <b>info@shop.test</b> or call +1 (555) 010-0199<p>second <!-- kept --> paragraph
<a href="https://sub.shop.test/x.pdf">pdf</a><a href="https://github.com/x">g</a><a href="//youtu.be/v">v</a><a href="javascript:x()">j</a><a href="#f">f</a><a href="mailto:a@b.test?subject=x">m</a><a href="tel:+1 555 0100 99">t</a>
<img src="/1.png" alt=""><img data-src="/2.png" srcset="/3.png 1x, /4.png 2x" alt="two"><video><source src="/m.mp4"></video><iframe src="https://www.youtube.com/embed/1"></iframe><script src="/jquery.js"></script><form></form>
<footer>&copy; 2024 Lamps Ltd</footer></body></html>"""


def rows(spark, pages):
    df = spark.createDataFrame(pages, "url string, html string")
    return [r.asDict() for r in extract(df).collect()]


def test_sample_page(spark):
    r = rows(spark, [("https://shop.test/", SAMPLE)])[0]
    assert list(r) == schema.COLUMNS and len(r) == 90
    expected = {
        "domain": "shop.test", "https": True, "page_title": "Shop — lamps and more", "meta_description": "We sell lamps", "site_name": "Lamp Shop", "language": "en", "charset": "utf-8", "twitter_handle": "@lamps", "favicon": "/fav.ico",
        "h1_text": "Brass x Lamps", "h1_count": 1, "h2_count": 0, "technology": "WordPress", "org_name": "Lamps Ltd", "org_founding_date": "2012", "org_location": "Austin, 1", "org_phone": "+1-555-0100", "jsonld_types": ["Organization"],
        "images_count": 2, "images_missing_alt": 1, "forms_count": 1, "iframes_count": 1, "scripts_count": 2, "styles_count": 1, "nav_links": ["https://shop.test/a"], "document_links": ["https://sub.shop.test/x.pdf"], "github_url": "https://github.com/x",
        "youtube_url": "https://youtu.be/v", "external_domains_list": ["github.com", "youtu.be"], "mailto_links": ["a@b.test"], "contact_emails": ["a@b.test", "info@shop.test", "ld@shop.test"], "image_urls_count": 5, "rss_feeds": ["https://shop.test/feed.xml"],
        "hreflang_urls": ["https://shop.test/de"], "copyright_text": "© 2024 Lamps Ltd", "headings_outline": "h1: Brass x Lamps", "rendering_type": "server_rendered", "technology_evidence": "generator:WordPress; lib:jquery",
        "media_urls": ["https://shop.test/m.mp4", "https://www.youtube.com/embed/1", "https://youtu.be/v"],
    }
    assert {k: r[k] for k in expected} == expected
    assert "second kept paragraph" in r["visible_text_preview"] and "no" not in r["visible_text_preview"].split("\n")
    assert "+1 (555) 010-0199" in r["contact_phones"] and "+1555010099" in r["contact_phones"]
    assert all(r[n] == len(r[c]) for n, c in schema.COUNTED.items())


def test_empty_null_and_broken_pages(spark):
    got = rows(spark, [("https://a.test/", None), ("https://a.test/", ""), (None, "<p>x"), ("https://a.test/", "<" * 50 + "<div>" * 5000 + "deep"), ("https://a.test/", "<b><p>one<p>two</b>three")])
    assert got[0]["rendering_type"] == "" and got[0]["h1_count"] is None and got[0]["all_urls"] == [] and got[0]["page_size_bytes"] == 0 and got[0]["domain"] == "a.test"
    assert got[1] == got[0] and got[2]["visible_text_preview"] == "x" and got[2]["url"] == ""
    assert got[3]["rendering_type"] != "" and got[4]["word_count"] >= 2
    assert extract(spark.createDataFrame([], "url string, html string")).count() == 0


def test_unclosed_inline_elements(spark):
    page = "<head><title>T</title></head><body><p>start " + "".join(f"<span> w{i} <font>" for i in range(20_000)) + "<b> end </b> <i> </i>"
    got = rows(spark, [("https://a.test/", page), ("https://a.test/", "<p>a <b> b <i> c </i> <br></b>d<img alt=' e '> <u> </u>\u200b f")])
    text = "start " + "".join(f"w{i} " for i in range(20_000)) + "end"
    assert (got[0]["page_title"], got[0]["fetch_error"], got[0]["visible_text_preview"], got[0]["character_count"]) == ("T", "", text[:500], len(text))
    assert got[1]["visible_text_preview"] == "a b cde f"


def test_unreadable_page_gives_its_reason(spark, monkeypatch):
    def broken(html, base):
        raise ValueError("no tree")

    monkeypatch.setattr(dom, "page_facts", broken)
    parse._udf.cache_clear()
    try:
        df = spark.createDataFrame([("https://a.test/1", "<p>x", ""), ("https://a.test/2", "<p>x", "cut off")], "url string, html string, fetch_error string")
        assert [r.fetch_error for r in extract(df).orderBy("url").collect()] == ["Page not read: ValueError: no tree", "cut off"]
    finally:
        parse._udf.cache_clear()


def test_one_parse_and_clean_audit(spark):
    df = spark.createDataFrame([("https://shop.test/", SAMPLE, 7)], "url string, html string, clues int")
    out = extract(df, ("clues",))
    assert out.columns[0] == "clues" and out.first()[0] == 7
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert audit.violations(out.drop("clues")).count() == 0
    assert audit.schema_faults(schema.COLUMNS) == [] and audit.schema_faults(schema.COLUMNS[1:]) == ["missing: url"]


def test_wire_round_trip(spark):
    typed = extract(spark.createDataFrame([("https://shop.test/", SAMPLE), ("https://a.test/", None)], "url string, html string"))
    wire = schema.to_wire(typed)
    assert {t for _, t in wire.dtypes} == {"string"} and wire.where("url IS NULL OR h1_count IS NULL").count() == 0
    assert sorted(map(str, schema.to_typed(wire).collect())) == sorted(map(str, typed.collect()))
