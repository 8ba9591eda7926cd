"""Parsing, selection, text rules, post-processing, extraction; registered queries against their SQL."""

import duckdb
import pytest

from feedweave import catalog
from feedweave.dom import css
from feedweave.dom.text import visible_text
from feedweave.dom.tree import lift, parse
from feedweave.functions import postprocess as pp
from feedweave.functions.urls import normalized, resolved
from feedweave.operators import extract, selectors

SF = "/root/testdata/sf0.001"
LIST = '<ul><li class="x y"><a href="/a">A</a></li><li id="two"><a href="/b#f">B <b>bold</b></a></li><li data-k="v w">C</li></ul>'


def names(sel, html=LIST):
    return [n.text() for n in css.select(parse(html), sel)]


@pytest.mark.parametrize(
    ("selector", "n"),
    [("li", 3), ("li.x.y", 1), ("#two", 1), ("li > a", 2), ("ul a[href^='/b']", 1), ("li:not(.x)", 2), ("li:first-child", 1), ("li:nth-child(2n+1)", 2), ("li + li", 2), ("li.x ~ li", 2), ("[data-k~=w]", 1), ("b, a", 3), ("li:last-of-type", 1)],
)
def test_css(selector, n):
    assert len(names(selector)) == n


def test_css_rejects_unknown():
    with pytest.raises(css.SelectorError):
        css.select(parse(LIST), "li::before")


def test_unclosed_tags():
    root = parse("<p>one<p><b>two<br><p>three</p><li>a<li>b")
    assert [n.text() for n in css.select(root, "p")] == ["one", "two", "three"]
    assert len(css.select(root, "li")) == 2


def test_visible_text():
    assert visible_text(css.first(parse("<div><h1>T</h1><p>a <i>b</i></p><ul><li>x</li></ul><script>no</script></div>"), "div")) == "T\na b\n- x"


def test_json_lift():
    root = lift({"data": [{"title": "x", "tags": [{"name": "t"}]}]})
    assert css.first(root, "data > array > object > title").text() == "x"


@pytest.mark.parametrize(("rel", "base", "want"), [("/a", "http://X.org/b", "http://x.org/a"), ("c?q=1", "http://x.org/b/d", "http://x.org/b/c?q=1"), ("https://y.org", "http://x.org", "https://y.org"), ("#f", "http://x.org/p", "http://x.org/p#f")])
def test_resolve(rel, base, want):
    assert resolved(rel, base) == want


def test_normalize():
    assert normalized("HTTP://Ex.org:80/a/../b c") == "http://ex.org/b%20c"


def test_post_processors():
    assert pp.gsub("Hello World", "/ w o r /", "-") == "Hello -ld"
    assert pp.gsub("a b", "[ab]", {"a": "1", "b": "2"}) == "1 2"
    assert pp.substring("abcdef", 1, 3) == "bcd"
    assert pp.substring("abcdef", -3, -2) == "de"
    with pytest.raises(ValueError):
        pp.substring("abc", 1, 1)
    assert pp.template("%{a}-%<b>s", {"a": "x", "b": None}.get) == "x-"
    assert pp.parse_time("2024-05-01 10:00", "America/New_York") == "Wed, 01 May 2024 10:00:00 -0400"
    with pytest.raises(ValueError):
        pp.parse_time("")
    assert pp.sanitize_html('<p onclick="x">a<script>b</script><a href="/c">d</a></p>', "http://x.org/") == '<p>a<a href="http://x.org/c" rel="nofollow noopener noreferrer" target="_blank">d</a></p>'
    assert pp.markdown_to_html("# T\n\n- a\n- **b**", "http://x.org") == "<h1>T</h1>\n\n<ul><li>a</li><li><strong>b</strong></li></ul>"
    assert pp.html_to_markdown("<h2>T</h2><p>a <em>b</em></p>", "http://x.org") == "## T\n\na _b_\n"
    with pytest.raises(pp.MissingOption):
        pp.check_step({"name": "gsub", "pattern": "x"})


def test_extract_card():
    html = '<article id="one"><span class="kicker">News</span><h2><a href="/p#c">Title here</a></h2><time datetime="2024-01-02">x</time><p>Body text.</p><p>Read more</p><img src="/i.png"></article>'
    item = css.first(parse(html), "article")
    got = extract.extract(item, "http://x.org/", extract.main_anchor(item))
    assert (got["title"], got["url"], got["id"], got["description"], got["image"], got["published_at"]) == ("News: Title here", "http://x.org/p", "one", "Body text.", "http://x.org/i.png", "2024-01-02")


def test_selector_query_edge_rows(spark):
    rows = [(1, "http://x.org/", "<div class=i><a href='/a'>A</a></div><div class=i></div>", "text/html"), (2, "http://x.org/", None, "text/html"), (3, "http://x.org/", '{"items": [{"t": "j"}]}', "application/json")]
    df = spark.createDataFrame(rows, "feed_id long, url string, body string, content_type string")
    config = {"selectors": {"items": {"selector": ".i", "enhance": False}, "title": {"selector": "a"}, "url": {"selector": "a", "extractor": "href"}}}
    got = {(r.feed_id, r.position): (r.title, r.url) for r in selectors.query(df, config).collect()}
    assert got == {(1, 0): ("A", "http://x.org/a"), (1, 1): (None, "http://x.org/")}
    config = {"selectors": {"items": {"selector": "items > array > object", "enhance": False}, "title": {"selector": "t"}}}
    assert [r.title for r in selectors.query(df.where("feed_id = 3"), config).collect()] == ["j"]
    assert selectors.query(df.where("feed_id > 9"), config).count() == 0


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("nation", "pages", "documents", "events", "conversations", "part", "orders"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    cur = db.execute(catalog.ORACLES[name])
    cols = [x[0] for x in cur.description]
    want = sorted(str([r[c] for c in sorted(r)]) for r in (dict(zip(cols, x, strict=True)) for x in cur.fetchall()))
    got = sorted(str([r[c] for c in sorted(r)]) for r in (x.asDict() for x in catalog.QUERIES[name](spark, SF).collect()))
    assert got == want


def test_references_by_name_need_their_semicolon():
    h1, a = (next(n for n in parse('<h1>a &amp;&amp &lt b&copyc &#65;&nosuch;</h1><a href="/x?a=1&copy=2&amp;b=3">l</a>').walk() if n.name == t) for t in ("h1", "a"))
    assert h1.text() == "a &&amp &lt b&copyc A&nosuch;" and a.attrs["href"] == "/x?a=1&copy=2&b=3"
    # the same where another piece of markup has the standard tokenizer read on
    late = parse("<!-- odd --><h1 title='&amp;&amp'>T &amp; U &amp</h1><script>a &amp;&amp b</script>")
    found = {n.name: n for n in late.walk()}
    assert found["h1"].text() == "T & U &amp" and found["h1"].attrs["title"] == "&&amp" and found["script"].text() == "a &amp;&amp b"
