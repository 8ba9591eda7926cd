"""Fetching through recordings, the fallback chain, registrable domains."""

import http.server
import threading

from pyspark.sql import functions as F

from feedweave.operators import admission, domains, paging
from feedweave.sources import fetch

HTML = {"Content-Type": "text/html"}


def test_recorded_pages(spark):
    tape = fetch.recorded({
        "https://a.example/1": (302, {"LOCATION": "/2"}, b""), "https://a.example/2": (200, HTML, b"<p>two"), "https://a.example/gone": (404, HTML, b"<p>none"),
        "https://a.example/loop": (301, {"Location": "loop"}, b""), "https://a.example/nowhere": (301, {}, b"x"),
    })
    rows = [(1, "https://a.example/1"), (2, "https://a.example/gone"), (3, "https://a.example/loop"), (4, "https://a.example/nowhere"), (5, "https://a.example/absent"), (6, "http://localhost/"), (7, None), (8, "https://a.example/2"), (8, "https://a.example/gone"), (9, "https://a.example/2")]
    requests = spark.createDataFrame(rows, "feed_id long, url string")
    got = {(r.feed_id, r.url): (r.status, r.error, r.hops, r.final_url) for r in fetch.fetch(requests, tape).collect()}
    assert got[1, "https://a.example/1"] == (200, None, 1, "https://a.example/2")
    assert got[2, "https://a.example/gone"][:2] == (404, None) and got[4, "https://a.example/nowhere"][:2] == (301, None)
    assert got[3, "https://a.example/loop"][1:3] == ("too_many_redirects", 6)
    assert got[5, "https://a.example/absent"][1] == "connection_failed"
    assert got[6, "http://localhost/"][1] == got[7, None][1] == "private_network"
    assert sorted(e or "" for (f, _), (_, e, *_) in got.items() if f == 8) == ["", "request_budget_exceeded"]
    assert len(got) == len(rows) and fetch.fetch(requests.limit(0), tape).count() == 0


def test_crawl_over_a_fetching_store(spark):
    tape = fetch.recorded({f"https://a.example/{k}": (200, HTML, f'<html><a rel="next" href="/{k + 1}">on</a>'.encode()) for k in range(1, 4)})
    start = spark.createDataFrame([(1, "https://a.example/1"), (2, "https://a.example/3"), (3, "https://a.example/none")], "feed_id long, url string")
    got = paging.crawl(fetch.store(tape), start, paging.rel_next, 5).select("feed_id", "page_no", "url").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "https://a.example/1"), (1, 1, "https://a.example/2"), (1, 2, "https://a.example/3"), (2, 0, "https://a.example/3")]


def test_fallback_chain(spark):
    plain = fetch.recorded({"https://a.example/1": (200, HTML, b"<li>x"), "https://a.example/2": (200, HTML, b"shell"), "https://a.example/4": (200, HTML, b"shell")})
    full = fetch.recorded({"https://a.example/2": (200, HTML, b"<li>x<li>y"), "https://a.example/3": (200, HTML, b"<li>x"), "https://a.example/4": (200, HTML, b"shell")})
    requests = spark.createDataFrame([(k, f"https://a.example/{k}") for k in (1, 2, 3, 4)] + [(5, "http://127.0.0.1/")], "feed_id long, url string")
    items = lambda raw: raw.select("feed_id", (F.size(F.split(F.decode("payload", "UTF-8"), "<li>")) - 1).alias("items"))
    attempts, raw = fetch.with_fallback(requests, {"plain": plain, "full": full}, items)
    assert sorted(map(tuple, attempts.select("feed_id", "rank", "items", "error").collect()), key=str) == sorted([(1, 0, 1, None), (2, 0, 0, None), (2, 1, 2, None), (3, 0, 0, "connection_failed"), (3, 1, 1, None), (4, 0, 0, None), (4, 1, 0, None), (5, 0, 0, "private_network")], key=str)
    assert sorted((r.feed_id, bytes(r.payload)) for r in raw.collect()) == [(1, b"<li>x"), (2, b"<li>x<li>y"), (3, b"<li>x")]
    assert {r.feed_id: r.selected_strategy for r in paging.first_success(attempts).collect()} == {1: "plain", 2: "full", 3: "full"}


def test_over_http(spark):
    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<p>" + self.path.encode() * (1 if self.path == "/small?q=1" else 9000))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        requests = spark.createDataFrame([(1, f"{base}/small?q=1"), (2, f"{base}/large")], "feed_id long, url string")
        got = {r.feed_id: r for r in fetch.fetch(requests, limits=fetch.Limits(allow_private=True, max_bytes=10_000)).collect()}
        assert bytes(got[1].payload) == b"<p>/small?q=1" and got[1].status == 200 and got[2].error == "response_too_large"
        assert {r.error for r in fetch.fetch(requests).collect()} == {"private_network"}
        named = spark.createDataFrame([(1, f"http://ip6-localhost:{server.server_port}/"), (2, "http://no-such-host.invalid/")], "feed_id long, url string")
        assert {r.error for r in fetch.fetch(named).collect()} <= {"private_network", "connection_failed"}
    finally:
        server.shutdown()


def test_domains_by_rules(spark):
    lines = spark.createDataFrame([(x,) for x in ("// comment", "", "com", "uk", "co.uk", "*.ck", "!www.ck", "*.compute.example  trailing")], "value string")
    hosts = {"www.shop.co.uk": "shop.co.uk", "shop.uk": "shop.uk", "co.uk": "co.uk", "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "b.ck": "b.ck", "ck": "ck", "www.ck": "www.ck", "z.www.ck": "www.ck", "a.b.c.compute.example": "b.c.compute.example", "x.y.zz": "y.zz", "localhost": "localhost", "10.1.2.3": "10.1.2.3", "[::1]": "[::1]"}
    table = spark.createDataFrame([(h,) for h in [*hosts, None, "www.shop.co.uk"]], "host string")
    assert {r.host: r.domain for r in domains.host_domains(table, domains.rules(lines)).collect()} == hosts
    c = spark.createDataFrame([(1, 0, "i", "A title of words", None, "https://a.b.ck/1", "https://c.b.ck/"), (1, 1, "j", "A title of words", None, "https://x.a.b.ck/2", "https://y.a.b.ck/")], "feed_id long, position int, id string, title string, description string, url string, page_url string")
    assert {r.position: r.reason for r in admission.reasons(c, suffixes=domains.rules(lines)).collect()} == {0: "different_domain", 1: None}
