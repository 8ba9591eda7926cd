"""Summaries, samples, score breakdowns, outcomes; discovery on odd pages."""

import json

from pyspark.sql import functions as F

from feedweave.functions import destinations
from feedweave.operators import diagnostics, discovery, followups, segments, shred


def test_samples_are_bounded(spark):
    rows = spark.createDataFrame([(1, k, f"v{k}") for k in range(9)] + [(2, 0, "w"), (None, 0, "x")], "g long, k int, v string")
    got = {r.g: list(r.s) for r in diagnostics.samples(rows, "g", ["k"], "v", "s").collect()}
    assert got == {1: ["v0", "v1", "v2", "v3", "v4"], 2: ["w"], None: ["x"]}


def test_breakdown_adds_up(spark):
    rows = spark.createDataFrame([("A long title of more than seven words", "https://x.org/blog/a-post-slug-here"), ("About", "https://x.org/about"), (None, None)], "title string, url string")
    o = segments.observation(F.col("title"), destinations.facts(F.col("url")), F.lit("/blog/a"), F.lit(True), F.lit(False), F.lit(False), F.lit("card"))
    q, j = segments.score(F.col("o"))
    for r in rows.select(o.alias("o")).select(q.alias("q"), j.alias("j"), segments.breakdown(F.col("o")).alias("b")).collect():
        got = r.b or {}
        quality, junk = ({k: v for k, v in got.items() if k in p} for p in (segments.L.QUALITY_POINTS, segments.L.JUNK_POINTS))
        assert sum(quality.values()) == r.q and sum(junk.values()) == r.j and len(quality) + len(junk) == len(got)


def test_captures_and_envelope(spark):
    body = json.dumps([{"title": "A title", "url": "/a"}, {"title": "Another", "url": "/b"}])
    rows = [(1, k, f"https://a.example/api/{k}?key=secret#x", body if k == 6 else "{}") for k in range(7)] + [(2, 0, "relative", "{}"), (3, 0, None, None)]
    got = {r.feed_id: r for r in diagnostics.capture_summary(spark.createDataFrame(rows, "feed_id long, position int, url string, body string")).collect()}
    assert got[1]["count"] == 7 and list(got[1].sample_endpoints) == [f"https://a.example/api/{k}" for k in range(5)] and got[1].candidate_articles
    assert list(got[2].sample_endpoints) == [] and not got[2].candidate_articles and got[3]["count"] == 1
    one = spark.range(1).select(diagnostics.envelope(diagnostics.apply_outcome(F.lit(0)), F.struct(F.lit(0).alias("item_count")))).first()[0]
    assert json.loads(one) == {"ok": False, "next_step": "inspect_url", "guidance": diagnostics.GUIDANCE["inspect_url"], "payload": {"item_count": 0}}
    assert set(diagnostics.GUIDANCE) == set(diagnostics.STEPS) >= set(diagnostics.ERROR_STEPS.values())


def test_sitemaps_that_are_odd(spark):
    bodies = [
        (1, "<urlset><url><loc>https://a/1</loc></url><url><loc>broken</url></urlset>"), (2, ""), (3, None), (4, "no xml"),
        (5, "﻿<?xml version='1.0'?><!-- c --><m:urlset xmlns:m='u' xmlns:image='i'><m:url><m:loc><![CDATA[https://a/?x=1&y=2]]></m:loc><image:image><image:title>no</image:title></image:image><n:news xmlns:n='n'><n:title>T &amp; U</n:title></n:news></m:url></m:urlset>"),
        (6, "<sitemapindex><sitemap><loc> </loc></sitemap><sitemap><loc>https://a/m.xml</loc></sitemap></sitemapindex>"),
    ]
    df = spark.createDataFrame(bodies, "feed_id long, body string")
    assert sorted((r.feed_id, r.url, r.title) for r in followups.sitemap(df, "2024-01-01").collect()) == [(1, "https://a/1", None), (5, "https://a/?x=1&y=2", "T & U")]
    assert [(r.feed_id, r.position, r.url) for r in followups.sub_sitemaps(df).collect()] == [(6, 0, "https://a/m.xml")]


def test_discovery_on_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<head><link rel=canonical href='ftp://x.org/a'><base href='/b'></head>"), (4, "<base><base href='HTTP://X.org:80/b/../c'>")], "page_id long, html string")
    nodes = shred.shred(pages, columns=discovery.NODES)
    assert {r.page_id: r.url for r in discovery.page_urls(nodes).collect()} == {3: "ftp://x.org/a", 4: "http://x.org/c"}
    assert discovery.alternate_feeds(nodes).count() == 0
    asked = discovery.sitemap_targets(nodes, spark.createDataFrame([(1, "https://a.example/x/y"), (2, None)], "page_id long, url string")).collect()
    assert [(r.page_id, r.url) for r in asked] == [(1, "https://a.example/sitemap.xml")]
    found = spark.createDataFrame([(1, "html"), (1, "schema"), (1, "html"), (2, "other")], "feed_id long, scraper string")
    assert [(r.feed_id, list(r.readers)) for r in discovery.eligible_readers(found, ["schema", "html"]).collect()] == [(1, ["schema", "html"])]
