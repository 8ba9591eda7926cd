"""The node relation on deep, large and odd pages; paging rounds, unions and descriptions on odd rows."""

import pytest
from pyspark.sql import functions as F

from feedweave.dom import css
from feedweave.dom.text import visible_text
from feedweave.dom.tree import lift, parse
from feedweave.functions import lexicon as L
from feedweave.operators import admission, feeds, paging, selectors, shred


def test_deep_page():
    root = parse("<div>" * 10_000 + "x y")
    assert visible_text(root) == "x y"
    assert root.html().count("<div>") == 10_000
    got = shred.rows(1, root)
    assert len(got["tag"]) == 10_002 and max(got["depth"]) == 10_001 and set(got["words"]) == {2}
    deep = value = []
    for _ in range(5_000):
        value.append([])
        value = value[0]
    assert sum(1 for _ in lift(deep).walk()) == 5_002


def test_intervals_and_leaves():
    got = shred.rows(7, parse("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><svg><g></g></svg><p>d <b>e</b>"))
    assert got["tag"] == ["html", "body", "ul", "li", "ul", "li", "li", "p", "b"]
    assert got["last_desc"] == [8, 8, 6, 5, 5, 5, 6, 8, 8]
    assert [t for t, n in zip(got["tag"], got["non_leaf"], strict=True) if n] == ["ul", "li"]
    assert got["child_tags"][:4] == ["body", "ul>p", "li>li", "ul"]
    assert got["words"] == [5, 5, 3, 2, 1, 1, 1, 2, 1]


def test_degrade_keeps_structure():
    body = "<i>x</i>" * L.MAX_NODES + "<div><b><p>lost with b</p></b><p>kept</p></div>"
    got = shred.rows(1, parse(body))
    assert got["degraded"][0] and got["tag"][-2:] == ["div", "p"] and got["tag"].count("p") == 1
    assert not shred.rows(1, parse("<i>x</i>" * 100))["degraded"][0]


def test_attributes_kept():
    got = shred.rows(1, parse('<a href="/x" rel="next" onclick="f()" data-id="3" aria-label="y">z</a>'))
    assert dict(got["attributes"][-1]) == {"href": "/x", "data-id": "3", "aria-label": "y"} and got["rel"][-1] == "next"


def test_shred_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (None, "<p>a"), (3, "<p>a"), (3, "<p>a")], "page_id long, html string")
    got = shred.shred(pages, columns=("page_id", "tag"))
    assert got.columns == ["page_id", "tag"]
    assert {(r.page_id, r["count"]) for r in got.where("tag = 'p'").groupBy("page_id").count().collect()} == {(None, 1), (3, 2)}
    assert shred.shred(pages.where("page_id > 9")).count() == 0


def test_crawl(spark):
    store = spark.createDataFrame([("http://x.org/1", '<a rel="next" href="/2#f">n</a>'), ("http://x.org/2", '<a rel="next" href="/1">n</a>'), ("http://x.org/3", '<a rel="next" href="/gone">n</a>'), ("http://x.org/4", None)], "url string, body string")
    start = spark.createDataFrame([(1, "http://x.org/1"), (2, "http://x.org/3"), (3, "http://x.org/4"), (4, None)], "feed_id long, url string")
    got = paging.crawl(store, start, paging.rel_next, 5).select("feed_id", "page_no").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 1), (2, 0)]
    assert paging.crawl(store, start.where("feed_id > 9"), paging.rel_next).count() == 0
    with pytest.raises(css.SelectorError):
        paging.by_selector("a::before")


def test_united_and_described(spark):
    page = spark.createDataFrame([(1, "http://x.org/", "<ul><li><a href='/a'>A</a></li></ul><p><a href='/a'>A</a></p><p><a href='/b'>B</a></p>", "text/html")], "feed_id long, url string, body string, content_type string")
    one, two = ({"selectors": {"items": {"selector": s, "enhance": False}, "title": {"selector": "a"}, "url": {"selector": "a", "extractor": "href"}}} for s in ("li", "p"))
    both = admission.united(selectors.query(page, one), selectors.query(page, two))
    assert [(r.position, r.url) for r in both.orderBy("position").collect()] == [(0, "http://x.org/a"), (2, "http://x.org/b")]
    rows = [("T", "T: <script>x</script>said <b>so</b>", None), ("Title", "a long text about the Title", None), (None, None, "http://x.org/i.png"), (None, None, None), ('a"b', "", "http://x.org/?a&b")]
    df = spark.createDataFrame(rows, "title string, description string, image string").selectExpr("*", "'http://x.org/' AS url", "cast(array() as array<struct<url:string,type:string,bytes_length:bigint>>) AS enclosures")
    got = [r[0] for r in df.select(feeds.described(df)).collect()]
    assert got[:2] == [": said <b>so</b>", "a long text about the Title"] and got[3] is None
    assert 'alt=""' in got[2] and 'alt="a&quot;b"' in got[4] and 'src="http://x.org/?a&amp;b"' in got[4]


def test_deep_markup_is_sanitized_whole(spark):
    from feedweave.functions import postprocess

    deep = "<b>" * 5000 + "<i onclick='x'>in</i>" + "</b>" * 5000
    assert postprocess.sanitize_html(deep, "https://x.org/") == "<b>" * 5000 + "<i>in</i>" + "</b>" * 5000
    assert postprocess.html_to_markdown("<blockquote>" * 1500 + "in", "https://x.org/").strip().endswith("in")
    assert postprocess.html_to_markdown("<ul><li>a<ol><li>b</li><li>c</li></ol></li></ul>", "") == "- a\n  1. b\n  2. c\n"
    rows = spark.createDataFrame([(deep,), ("plain  text\n\n\n\nmore ",), ("a &amp; b",), (" ",), (None,), ("<script>x</script>",)], "t string")
    got = [r[0] for r in rows.select(feeds.clean_html(F.col("t"), F.lit("https://x.org/"))).collect()]
    assert got == ["<b>" * 5000 + "<i>in</i>" + "</b>" * 5000, "plain text\n\nmore", "a &amp; b", None, None, None]
