"""Scalar functions, on the cases where built-ins and intent differ."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.functions import urls as U

SITE = "www.example.com"


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(("value", "want"), [(" \t a b\n", "a b"), ("", ""), (None, None)])
def test_strip(spark, value, want):
    assert one(spark, X.strip("x"), value) == want


def test_split_keeps_trailing_fields(spark):
    assert one(spark, X.split_fields("x"), "a[=]b[=]") == ["a", "b", ""]
    assert one(spark, X.split_list("x"), "a,,b,") == ["a", "b"] and one(spark, X.split_list("x"), None) == []
    assert one(spark, X.trim_comma("x"), "a,,") == "a,"


def test_times(spark):
    assert str(one(spark, X.parse_time("x"), "2012-08-01 10:00:00")) == "2012-08-01 10:00:00" and one(spark, X.parse_time("x"), "x") is None
    assert str(one(spark, X.first_date("x"), "on 2012-04-12 and 2013-01-01")) == "2012-04-12" and one(spark, X.first_date("x"), "none") is None
    rows = spark.createDataFrame([("2012-08-01",), ("2012-08-02",), ("2012-08-03",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert rows.where(X.in_window("t", "2012-08-01", "2012-08-03")).count() == 2 and rows.where(X.in_window("t")).count() == 3


def test_cjk_range(spark):
    assert one(spark, X.count_cjk("x"), "一龥龦あ１a") == 2 and one(spark, X.count_cjk("x"), None) == 0


def test_links_in_text(spark):
    assert one(spark, X.remove_urls("x"), "see http://a.example/b?c=1 end") == "see  end"
    two = "http://img.example.com/a.jpg http://img.example.com/b.jpg"
    assert one(spark, X.count_images("x", "img.example.com"), two) == 1 and one(spark, X.count_images("x", "img.example.com", lazy=True), two) == 2
    assert one(spark, X.external_link("x", SITE), "http://WWW.example.com/a") == 0 and one(spark, X.external_link("x", SITE), "http://www.example.com/a http://b.example/c") == 1 and one(spark, X.external_link("x", SITE), "none") == 0


def test_tokens(spark):
    assert one(spark, X.tokens("x", ["stop"]), "Stop a 12 1e5 nan 1d word  inf .5 1_0 ok") == ["1d", "word", "ok"]
    assert one(spark, X.segment("x"), "今天天气 good day2") == "今天 天天 天气 good day2"
    assert one(spark, X.segmenter(str.split)("x"), "a  b") == "a b"


def test_distance_and_casts(spark):
    pair = lambda a, b: X.distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))
    assert one(spark, pair([0.0, 3.0], [4.0, 0.0])) == 5.0 and one(spark, pair([0.0], [4.0, 0.0])) is None
    assert one(spark, X.to_number("x"), " 1.5 ") == 1.5 and one(spark, X.to_number("x"), "x") is None


@pytest.mark.parametrize(("url", "kind", "ident"), [
    ("http://www.example.com/people/bob_1/", "people", "bob_1"), ("http://www.example.com/group/ustv/", "group", "ustv"), ("http://www.example.com/group/topic/12/", "topic", "12"),
    ("http://www.example.com/group/g/discussion?start=25", "discussion", "g"), ("http://www.example.com/group/topic/12/?start=100", "comment", "12"), ("http://other.example/", None, None),
])
def test_url_classes(spark, url, kind, ident):
    assert one(spark, U.url_class("x", SITE), url) == kind
    assert kind is None or one(spark, U.url_id("x", kind, SITE), url) == ident


@pytest.mark.parametrize(("href", "want"), [
    ("http://b.example/", "http://b.example/"), ("//c.example/x", "http://c.example/x"), ("/r", "http://a.example/r"), ("?q=1", "http://a.example/d/e?q=1"), ("#f", "http://a.example/d/e?p=0#f"),
    ("s", "http://a.example/d/s"), ("./s", "http://a.example/d/s"), ("../s", "http://a.example/s"), ("", "http://a.example/d/e?p=0"),
])
def test_resolve(spark, href, want):
    assert one(spark, U.resolve(F.lit("http://a.example/d/e?p=0"), "x"), href) == want


def test_resolve_against_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["http://h.example/a/b/c", "http://h.example/a/b/", "http://h.example", "https://h.example:8/x?q=1#f", "http://h.example/a/b/c;p?q"]
    hrefs = ["", "x", "./x", "../x", "../../x", "../../../up", "/a/../b", "a/b/../../../../c", "//o.example/z/../y", "//o.example", "?y=2", "?", "#s", "#", "x?y#z", "HTTP://h2.example/q", "http:g", "mailto:a@b", ".", "..", "./", "../", "a//b", "/", "//", "g;x=1/../y", "..g", "g..", "a/./b/../c/", "http://h.example/a/./b", "x/y?q=../z", ";x"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in rows.select("b", "h", U.resolve("b", "h").alias("t")).collect():
        assert r.t == urljoin(r.b, r.h), (r.b, r.h)
    assert rows.select(U.resolve(F.lit(None).cast("string"), "h"), U.resolve("b", F.lit("  /s\n"))).first()[1] == "http://h.example/s"


def test_links_and_references(spark):
    from colloquy.operators import html

    page = """<a href='/one'>x</a><a href=/two>y</a><A title='a>b' HREF = "/four?a=1&amp;b=2">z</A><!-- <a href=/no> --><script>'<a href=/no>'</script>
<a name=q><a data-href=/no href="five"><area href=/no><abbr href=/no><a\nhref="six"><a href="">e</a><a href=caf&eacute;>"""
    found = html.links(spark.createDataFrame([("http://h.example/p/", page)], "url string, html string")).collect()
    assert [r.href for r in found] == ["/one", "/two", "/four?a=1&b=2", "five", "six", "", "café"] and found[3].target == "http://h.example/p/five"
    assert one(spark, html.title("x"), "<h1>caf&eacute;&nbsp;&#8217;x &amp;lt;</h1>") == "café\xa0’x &lt;"
    assert one(spark, html.hrefs("x"), "<a " + "k='v' " * 5000 + "href=y>") == ["y"]


def test_sites_are_literal(spark):
    assert one(spark, U.url_class("x", "a.example"), "http://aXexample/people/u/") is None and one(spark, U.url_class("x", "a.example"), "http://a.example/people/u/") == "people"


def test_pages_and_starts(spark):
    assert one(spark, U.page_number(F.lit(200))) == 3 and one(spark, U.off_page(F.lit(50)))
    assert one(spark, U.start_url("x"), "a.example") == "http://a.example" and U.positive(3) == 3
    with pytest.raises(ValueError):
        U.positive(0)
