"""Links, records and detection on small pages."""

import pytest
from pyspark.sql import functions as F

from harvest.functions import text as X
from harvest.operators import detect as D
from harvest.operators import extract as E
from harvest.operators import frontier as R
from harvest.sources.pages import as_pages

DETAIL = """<html><head><title>Harbour news</title></head><body><h1 class="headline">渡轮恢复运行</h1>
<em class="when">12 March, noon</em><section class="story">
 <p>风停了。</p> <p>The ferry sails twice a day.</p></section></body></html>"""


def page(spark, html, url="https://example.test/list"):
    return as_pages(spark.createDataFrame([(url, html)], "url string, html string"))


def links(spark, html, selector="a[href]", url="https://example.test/list"):
    return [r.target_url for r in E.extract_links(page(spark, html, url), selector).orderBy("pos").collect()]


@pytest.mark.parametrize("html, selector, url, want", [
    ('<ul><li><a href="/page/1">1</a></li><li><a href="/page/2">2</a></li></ul>', "a[href]",
     "https://example.test/list", ["https://example.test/page/1", "https://example.test/page/2"]),
    ('<nav><a href="/nav">N</a></nav><div class="list"><a href="/i/1" class="item-link">A</a></div>',
     ".list a.item-link", "https://example.test/list", ["https://example.test/i/1"]),
    ('<a href="detail.html">L</a>', "a[href]", "https://example.test/news/", ["https://example.test/news/detail.html"]),
    ('<a href="https://other.test/page">L</a>', "a", "https://example.test/list", ["https://other.test/page"]),
    ("<p>none</p>", "a", "https://example.test/list", []),
    ('<a href="/same">A</a><a href="/same">B</a><a href="/other">C</a>', "a", "https://example.test/",
     ["https://example.test/same", "https://example.test/other"]),
    ('<a href="javascript:void(0)">J</a><a href="#">F</a><a href=" ">S</a><a>N</a><a href="mailto:a@b.c">M</a>',
     "a", "https://example.test/", ["mailto:a@b.c"]),
    ("<div><a href='/ok'>ok</a><p unclosed", "a", "https://example.test/", ["https://example.test/ok"]),
    ('<base href="https://b.test/"><a href="x#f">1</a><a href="?q">2</a><a href="../y">3</a>', "a",
     "https://example.test/d/p", ["https://example.test/d/x#f", "https://example.test/d/p?q", "https://example.test/y"]),
])
def test_links(spark, html, selector, url, want):
    assert links(spark, html, selector, url) == want


def test_unsupported_selector_raises_when_the_plan_is_built(spark):
    with pytest.raises(ValueError):
        E.extract_links(page(spark, ""), "a:hover")


def item(spark, html, **selectors):
    fetched = page(spark, html, "https://example.test/article/1").withColumns({
        "line_id": F.lit("l1"), "source_id": F.lit("s1"), "line_name": F.lit("Channel")})
    return E.data_items(fetched, **selectors).first()


def test_record_by_selectors(spark):
    row = item(spark, DETAIL, title="h1.headline", time=".when", content=".story")
    assert (row.title, row.published_at_raw, row.content, row.url, row.line_id, row.source_id) == (
        "渡轮恢复运行", "12 March, noon", "风停了。The ferry sails twice a day.", "https://example.test/article/1", "l1", "s1")


def test_record_fallbacks(spark):
    row = item(spark, DETAIL, title=".no", time=".no", content=".no")
    assert (row.title, row.published_at_raw, row.content) == ("Channel", None, DETAIL)
    row = item(spark, "", title="h1", content=".body")
    assert (row.title, row.content) == ("Channel", "")
    row = item(spark, "<h1> </h1>", title="h1")
    assert (row.title, row.content) == ("Channel", "<h1> </h1>")


def test_resolve_url_fast_and_slow_ways_agree(spark):
    from urllib.parse import urljoin

    bases = ["https://a.test/x/y?q#f", "http://a.test:81", "https://a.test/x/", "", "ftp://h/x"]
    refs = ["/p", "/p/../q", "/p;v", "//h/p", "p", "?z", "#f", "https://b.test", "https://b.test/p?", "HTTPS://B.test/p",
            "https://b.test/a b", "mailto:x", "/", "/p?x=/../y", "http:foo", "/a/./b", "https://b.test/#", "/p#"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", X.resolve_url(F.col("b"), F.col("r")).alias("u")).collect():
        assert row.u == urljoin(row.b, row.r), (row.b, row.r)


def test_strip_is_unicode(spark):
    df = spark.createDataFrame([("　\xa0\x1c x y  \n",)], "t string")
    assert df.select(X.strip(F.col("t"))).first()[0] == "x y"


def detect(spark, html):
    return D.detect_selectors(page(spark, html)).first()


LONG = "港口的早晨没有风，渡轮照常开往小岛。" * 8


@pytest.mark.parametrize("html, field, want", [
    ('<nav><a href="/a">A</a></nav><div class="item"><a href="1">1</a></div><div class="item"><a href="2">2</a></div>'
     '<div class="item"><a href="3">3</a></div>', "link_selectors", ["div.item a[href]"]),
    ('<a href="/1">1</a><a href="/2">2</a>', "link_selectors", []),
    ('<a href="/1">1</a><a href="/2">2</a><a href="/3">3</a>', "link_selectors", []),
    ("<i><a href=1></a><a href=2></a><a href=3></a></i><b><a href=1></a><a href=2></a><a href=3></a></b>",
     "link_selectors", ["i a[href]"]),
    ('<h1 class="t u">T</h1>', "title_selector", "h1.t.u"),
    ('<h1></h1><h1>x</h1><h2 id="s">S</h2>', "title_selector", "#s"),
    ("<h1></h1><h1>x</h1>", "title_selector", None),
    ('<span datetime="1">s</span><time>t</time>', "time_selector", "time"),
    ('<span class="publish-time" datetime="1">s</span>', "time_selector", "span.publish-time"),
    ('<i class="update-time">x</i><i class="post-date">x</i>', "time_selector", ".post-date"),
    ('<div class="dates">x</div>', "time_selector", None),
    (f'<article>short</article><div class="content">{LONG}</div>', "content_selector", ".content"),
    (f"<div id=giant>{LONG}</div><article>{LONG}</article>", "content_selector", "article"),
    (f'<div class="nav"><a href="1">{LONG}</a></div><div id="text">{LONG}</div>', "content_selector", "#text"),
    (f"<div><div>{LONG}</div></div>", "content_selector", "div"),
    ("", "content_selector", None),
    ("<div>" + "x" * 100 + "</div>", "content_selector", "div"),
    ("<article>" + "x" * 100 + "</article>", "content_selector", "article"),
    ("<div>" + "x" * 99 + "</div>", "content_selector", None),
])
def test_detection(spark, html, field, want):
    assert detect(spark, html)[field] == want


@pytest.mark.parametrize("html, want", [
    ('<h1 class="md:flex">x</h1>', "unsupported selector: h1.md:flex"), ('<h2 id="1a">x</h2>', "unsupported selector: #1a"),
    ('<h1 class="标题 a_b--c">x</h1><i class="date"></i>', None)])
def test_unusable_detection_is_named(spark, html, want):
    assert detect(spark, html).selector_error == want


def test_null_pages_are_empty_pages(spark):
    raw = spark.createDataFrame([("u", None), (None, "<h1>x</h1>")], "url string, html string")
    assert E.html_nodes(raw).count() == 1
    assert E.extract_links(raw).count() == 0 and E.next_link(raw, "a").count() == 0
    rows = {r.page_url: r.title_selector for r in D.detect_selectors(raw).collect()}
    assert rows == {"u": None, None: "h1"}
    assert as_pages(raw).filter("url = 'u'").first().html == ""


def test_custom_items_checks_fields(spark):
    fetched = page(spark, "<p>a").withColumns({
        "line_id": F.lit("l"), "source_id": F.lit("s"), "line_name": F.lit("n")})
    rows = E.custom_items(fetched, lambda row: [{"title": row["html"]}, {"url": "u2"}]).orderBy("record_no").collect()
    assert [(r.url, r.title, r.request_url) for r in rows] == [
        ("https://example.test/list", "<p>a", "https://example.test/list"), ("u2", "", "https://example.test/list")]
    with pytest.raises(Exception, match="unknown fields"):
        E.custom_items(fetched, lambda row: [{"colour": 1}]).collect()


def test_paginate_on_random_functional_graphs(spark):
    import random

    rnd = random.Random(3)
    onward = {f"g{g}-{i}": f"g{g}-{rnd.randrange(8)}" for g in range(40) for i in range(8) if rnd.random() < 0.85}
    starts = [f"g{g}-{rnd.randrange(8)}" for g in range(40)]
    nxt = spark.createDataFrame(list(onward.items()), "page_url string, next_url string")
    for most in (None, 3, 1, 0):
        want = set()
        for start in starts:
            at, seen = start, []
            while at is not None and at not in seen and (most is None or len(seen) < most):
                want.add((start, len(seen), at))
                seen.append(at)
                at = onward.get(at)
        got = R.paginate(spark.createDataFrame([(s,) for s in starts], "start string"), nxt, most)
        assert {(r.start, r.page_no, r.url) for r in got.collect()} == want
