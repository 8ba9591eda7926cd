"""Structured readers and follow-up sources: edge rows that the registered queries do not hold."""

import json

from pyspark.sql import functions as F

from feedweave.dom.tree import parse
from feedweave.operators import followups, structured


def test_things_walk():
    deep = {"@type": "Article", "name": "x"}
    for _ in range(3000):
        deep = {"a": [deep]}
    assert [t["name"] for t in structured.things(deep)] == ["x"]
    mixed = {"@graph": [{"@type": "BlogPosting", "name": "b", "hasPart": {"@type": "Article"}}], "hasPart": {"@type": "Report", "name": "a"}}
    assert [t["name"] for t in structured.things(mixed)] == ["a", "b"]
    assert list(structured.things([None, 1, "x", {"@type": None}])) == []


def test_thing_fields():
    got = structured.thing({"@type": "Article", "@id": "https://x.org/?p=4", "url": "/a", "image": ["/no"], "thumbnailUrl": {"@type": "ImageObject", "contentUrl": "/i.png"}, "publisher": {"name": " P "}, "about": [{"name": "s"}, "t"]}, "https://x.org/")
    assert (got["id"], got["url"], got["image"], got["author"], got["categories"]) == ("/?p=4", "https://x.org/a", "https://x.org/i.png", "P", ["s", "t"])
    assert structured.thing({"@id": "urn:1"}, "https://x.org/")["id"] == "urn:1"
    assert structured.thing({}, "https://x.org/")["title"] is None


def test_find_presence_wins():
    assert structured.find({"title": None, "name": "n"}, structured.TITLE_KEYS) is None
    assert structured.find({"attributes": {"name": "n"}}, structured.TITLE_KEYS) == "n"
    assert structured.find({"data": [{}, {"name": "n"}]}, structured.TITLE_KEYS) == "n"


def test_block_and_literals():
    assert structured.block('x = {"a": "}", b: [1]}; y') == '{"a": "}", b: [1]}'
    assert structured.block("none") == "none"
    assert structured.js_value("{a: 1, b: [2,],}") == {"a": 1, "b": [2]}
    assert structured.js_value("{a: f()}") is None


def test_nested_microdata_is_no_root():
    html = '<div itemscope itemtype="https://schema.org/Article" itemid="/a"><p itemprop="headline">H</p><div itemprop="author" itemscope itemtype="https://schema.org/Article"><a itemprop="url" href="/no">N</a></div></div>'
    assert [(a["title"], a["url"]) for a in structured.microdata(parse(html), "https://x.org/")] == [("H", "https://x.org/a")]


def test_scrape_edges(spark):
    rows = [(1, "https://x.org/", None), (2, "https://x.org/", ""), (3, None, '<script type="application/ld+json">{bad</script>'), (4, "https://x.org/", '<script type="application/ld+json">{"@type":"Article","name":"n"}</script>' * 2)]
    df = spark.createDataFrame(rows, "feed_id long, url string, body string")
    assert [(r.feed_id, r.position, r.title) for r in structured.scrape(df).orderBy("feed_id", "position").collect()] == [(4, 0, "n"), (4, 1, "n")]
    assert structured.scrape(df.where("feed_id > 9")).count() == 0
    assert structured.captured(df).count() == 0


def test_archive_scope(spark):
    rows = [("", "https://x.org/2024/02/31/"), ("", "https://x.org/2024/13"), ("", "https://x.org/2024/12"), ("single", "https://x.org/a"), (None, "https://x.org/"), ("tag", "https://x.org/"), ("archive", "https://x.org/"), ("author-3 author", "https://x.org/?paged=02")]
    df = spark.createDataFrame(rows, "c string, u string")
    got = [json.loads(r.s) for r in df.select(F.to_json(followups.archive_scope(F.col("c"), F.col("u"))).alias("s")).collect()]
    assert [(g["reason"], g["fetchable"]) for g in got] == [
        ("unsupported_archive", False), ("archive", True), ("archive", True), ("non_archive", False), ("unscoped", True), ("unsupported_archive", False), ("unsupported_archive", False), ("archive", True),
    ]
    assert got[1]["query"] == {"after": "2024-01-01T00:00:00Z", "before": "2025-01-01T00:00:00Z"}
    assert got[2]["query"] == {"after": "2024-12-01T00:00:00Z", "before": "2025-01-01T00:00:00Z"}
    assert got[7]["query"] == {"author": "3", "page": "2"}


def test_sub_sitemaps(spark):
    body = "<sitemapindex>" + "".join(f"<sitemap><loc>https://x.org/{i}</loc></sitemap>" for i in range(5)) + "<sitemap><loc> </loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([(1, body), (2, None)], "feed_id long, body string")
    assert [r.url for r in followups.sub_sitemaps(df).orderBy("position").collect()] == [f"https://x.org/{i}" for i in range(3)]
    assert followups.sitemap(df, "2024-01-01").count() == 0
