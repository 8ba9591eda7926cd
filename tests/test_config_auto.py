"""Configurations, stored responses, request policy, automatic feeds and inferred selectors."""

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from feedweave import cli
from feedweave.operators import auto, policy
from feedweave.plans import config
from feedweave.sources import responses

GOOD = {"channel": {"url": "https://x.org/"}, "selectors": {"items": {"selector": "li"}, "title": {"selector": "a"}}}


@pytest.mark.parametrize(
    ("change", "path"),
    [
        ({"channel": None}, "channel"),
        ({"channel": {"url": "https://u@x.org/"}}, "channel.url"),
        ({"channel": {"url": "https://x.org/?a=b@c"}}, "channel.url"),
        ({"channel": {"url": "https://x.org/", "language": "EN"}}, "channel.language"),
        ({"channel": {"url": "https://x.org/", "ttl": 0}}, "channel.ttl"),
        ({"headers": {"A": 1}}, "headers.A"),
        ({"strategy": "other"}, "strategy"),
        ({"request": {"max_requests": 0}}, "request.max_requests"),
        ({"directory": {"title": "t", "topics": ["cats"]}}, "directory.topics"),
        ({"selectors": {"items": {"selector": ""}}}, "selectors.items.selector"),
        ({"selectors": {"items": {"selector": "li", "order": "up"}}}, "selectors.items.order"),
        ({"selectors": {"items": {"selector": "li", "pagination": {"strategy": "json_cursor"}}}}, "selectors.items.pagination"),
        ({"selectors": {"items": {"selector": "li"}, "a": {"extractor": "attribute"}}}, "selectors.a.attribute"),
        ({"selectors": {"items": {"selector": "li"}, "a": {"post_process": [{"name": "none"}]}}}, "selectors.a.post_process"),
        ({"selectors": {"items": {"selector": "li"}, "guid": ["a"]}}, "selectors.guid"),
        ({"selectors": {"items": {"selector": "li"}, "enclosure": {"content_type": "x"}}}, "selectors.enclosure.content_type"),
        ({"auto_source": {"scraper": {"other": {}}}}, "auto_source.scraper.other"),
    ],
)
def test_problems(change, path):
    assert config.problems(GOOD) == []
    assert path in [p for p, _ in config.problems(GOOD | change)]


def test_needs_a_source():
    assert config.problems({"channel": {"url": "https://x.org/"}}) == [("", "needs selectors or auto_source")]


def test_feed_of_many():
    doc = {"headers": {"A": "1", "B": "2"}, "stylesheets": [{"href": "g"}], "feeds": {"f": {"headers": {"A": "3"}, "stylesheets": [{"href": "l"}]}}}
    assert config.feed_of(doc, "f") == {"headers": {"A": "3", "B": "2"}, "stylesheets": [{"href": "l"}, {"href": "g"}]}
    with pytest.raises(KeyError):
        config.feed_of(doc, "g")
    assert config.from_yaml(config.to_yaml(GOOD)) == GOOD


def test_params_and_headers():
    assert config.with_params({"a": ["%{x}-%<x>s", 1]}, {"x": 5}) == {"a": ["5-5", 1]}
    assert config.with_params("%{y}", {}, missing="?") == "?"
    with pytest.raises(config.ParamsMissing):
        config.with_params("%{y}", {})
    got = config.headers({"accept": "text/plain, text/html", "x-a": "1"}, "de_ch", "https://X.org/a")
    assert (got["Accept"].split(",")[0], got["Accept"].count("text/html"), got["X-A"], got["Accept-Language"], got["Host"]) == ("text/plain", 1, "1", "de-CH,de;q=0.9", "x.org")


def test_budget():
    assert config.request_budget(GOOD | {"strategy": "faraday"}) == 1
    assert config.request_budget(GOOD | {"strategy": "faraday", "selectors": {"items": {"selector": "li", "pagination": 3}}}) == 3
    assert config.request_budget({"strategy": "auto", "auto_source": {}}) == 7
    assert config.request_budget(GOOD | {"request": {"max_requests": 99}}) == 10


def test_schema_is_json():
    assert json.loads(json.dumps(config.json_schema()))["required"] == ["channel"]


def test_decompress_and_decode():
    page = "<html>é</html>".encode()
    bare = zlib.compressobj(wbits=-15)
    for raw, enc in ((gzip.compress(page), "gzip"), (zlib.compress(page), "deflate"), (bare.compress(page) + bare.flush(), "deflate"), (gzip.compress(page), None), (zlib.compress(gzip.compress(page)), "gzip, deflate"), (page, "br"), (page, "gzip")):
        assert responses.decompressed(raw, enc) == page
    with pytest.raises(responses.TooLarge):
        responses.decompressed(gzip.compress(b"0" * 1000), "gzip", 999)
    assert responses.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert responses.decoded(b'<meta charset="latin1">\xe9', None).endswith("é")
    assert responses.decoded(b"\xe9", "text/html; charset=none-such") == "�"
    assert responses.kind_of(b" \n<!DOCTYPE  html>", "text/plain") == "text/html"
    assert responses.kind_of(b"x <html>", "text/plain") is None


def test_responses(spark):
    rows = [
        (1, "https://x.org/", {"Content-Type": "text/html"}, gzip.compress(b"<html>a</html>")),
        (2, "https://x.org/", {"content-type": "application/json"}, b"[1]"),
        (3, "https://x.org/", {}, b"plain"),
        (4, None, None, None),
        (5, "https://x.org/", {"content-type": "text/html"}, b"0" * 101),
        (6, "https://x.org/", {"content-type": "text/html"}, gzip.compress(b"0" * 1000)),
    ]
    raw = spark.createDataFrame(rows, "feed_id long, url string, headers map<string,string>, payload binary")
    got = {r["feed_id"]: (r["body"], r["error"]) for r in responses.responses(raw, max_response_bytes=100, max_decompressed_bytes=500).collect()}
    assert got[1] == ("<html>a</html>", None)
    assert got[2] == ("[1]", None)
    assert got[3] == got[4] == (None, "unsupported_content_type")
    assert got[5] == (None, "response_too_large")
    assert got[6] == (None, "decompressed_too_large")
    assert responses.responses(raw.limit(0)).count() == 0


def test_private_targets(spark):
    cases = {
        "http://localhost/": True, "http://10.1.2.3/a": True, "http://[::1]:80/": True, "http://[fe80::1]/": True, "http://[fd00::1]/": True, "http://172.32.0.1/": False, "http://172.31.0.1/": True,
        "https://example.org/": False, "http://[2001:db8::1]/": False, "http://224.0.0.1/": True, "http://8.8.8.8:8080/": False, "no url": True,
    }
    df = spark.createDataFrame([(u, w) for u, w in cases.items()], "u string, wanted boolean")
    assert [r["u"] for r in df.where(policy.private_target(F.col("u")) != F.col("wanted")).collect()] == []
    names = spark.createDataFrame([(["8.8.8.8"], False), (["8.8.8.8", "127.0.0.1"], True), ([], True), (None, True)], "a array<string>, wanted boolean")
    assert names.where(policy.private_target(F.lit("https://x.org/"), F.col("a")) != F.col("wanted")).count() == 0


def test_denial(spark):
    rows = [
        ("https://x.org/b", "https://x.org/", "follow_up", None), ("http://x.org/b", "https://x.org/", "follow_up", "unsupported_url_scheme"), ("https://y.org/", "https://x.org/", "follow_up", "cross_origin_follow_up"),
        ("https://x.org:8443/", "https://x.org/", "follow_up", "cross_origin_follow_up"), ("https://x.org:443/", "https://x.org/", "follow_up", None), ("https://y.org/", "https://x.org/", "initial", None), ("http://127.0.0.1/", "http://127.0.0.1/", "initial", "private_network"),
    ]
    df = spark.createDataFrame(rows, "u string, o string, r string, wanted string")
    got = df.withColumn("got", policy.denial(F.col("u"), F.col("o"), F.col("r")))
    assert got.where(~F.col("got").eqNullSafe(F.col("wanted"))).collect() == []


ITEM = '<div class="card {k}"><h2><a href="/news/2024/{k}-long-story-title">A long story title number {k}</a></h2><p>Some words about it.</p></div>'
PAGE = "<html><head><title>T</title></head><body><main>" + "".join(ITEM.format(k=k) for k in ("one", "two", "three")) + "</main></body></html>"


def test_auto_source(spark):
    ld = '<html><script type="application/ld+json">' + json.dumps([{"@type": "Article", "@id": f"a{k}", "url": f"/news/2024/article-number-{k}", "headline": f"Story with a title {k}"} for k in range(3)]) + "</script><body></body></html>"
    pages = spark.createDataFrame([(1, "https://x.org/", PAGE), (2, "https://x.org/", ld), (3, "https://x.org/", "<p>none</p>"), (4, "https://x.org/", None)], "feed_id long, url string, body string")
    rows = auto.auto_source(pages, {"limit": 2}).orderBy("feed_id", "position").collect()
    assert [(r["feed_id"], r["position"]) for r in rows] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert {r["scraper"] for r in rows if r["feed_id"] == 2} == {"schema"}
    assert rows[0]["url"].startswith("https://x.org/news/2024/")
    off = auto.auto_source(pages, {"scraper": {k: {"enabled": False} for k in auto.TIERS}})
    assert off.count() == 0


def test_capture(spark):
    pages = spark.createDataFrame([(1, "https://x.org/", PAGE), (2, "https://x.org/", "<p>none</p>")], "feed_id long, url string, body string")
    got = auto.capture(pages, auto.auto_source(pages)).collect()
    assert [(r["feed_id"], r["matches"]) for r in got] == [(1, 3)]
    assert got[0]["selector"] == "div.card"


def test_paths(spark):
    df = spark.createDataFrame([("html>body>div>div>ul>li", "ul > li"), ("html>body>div", "div"), ("html>body", "body"), ("main>div>p", "main > div > p")], "p string, wanted string")
    assert df.where(auto.path_selector(F.col("p")) != F.col("wanted")).collect() == []
    paths = spark.createDataFrame([(1, "a>b>c"), (1, "a>b>d>e"), (2, "a>b"), (2, "a>b"), (3, "a"), (3, "b"), (4, "a>b"), (4, "a>b>c")], "g int, tag_path string")
    assert {r["g"]: r["path"] for r in auto.common_path(paths, ["g"]).collect()} == {1: "a>b", 2: "a>b", 3: "", 4: "a>b"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.html").write_text(PAGE)
    conf = {"channel": {"url": "https://x.org/"}, "request": {"local_file_path": str(tmp_path / "p.html")}, "selectors": {"items": {"selector": ".card"}, "title": {"selector": "h2"}}}
    (tmp_path / "c.yml").write_text(config.to_yaml(conf))
    assert cli.main(["validate", str(tmp_path / "c.yml")]) == 0
    assert cli.main(["feed", str(tmp_path / "c.yml"), "--format", "json"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["items"]) == 3
    (tmp_path / "c.yml").write_text("channel: {}\n")
    assert cli.main(["validate", str(tmp_path / "c.yml")]) == 1
    assert cli.main(["schema"]) == 0


def test_strategy_plans():
    assert config.strategy_plan("auto") == config.FALLBACK_CHAIN and config.strategy_plan("local_file") == ("local_file",)
    assert config.diagnostic_strategy() == config.diagnostic_strategy("auto") == config.FALLBACK_CHAIN[0] and config.diagnostic_strategy("botasaurus") == "botasaurus"
    assert config.valid_strategy("auto") and not config.valid_strategy("none") and not config.valid_strategy(None)
    with pytest.raises(ValueError, match="unknown strategy"):
        config.strategy_plan("none")
