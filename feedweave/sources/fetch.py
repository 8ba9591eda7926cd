"""Pages fetched as a source: requests in rounds of one hop, an injected transport, errors as rows.

Requests are dealt by host, PER_HOST tasks at most for each host, and a round asks for one hop of every request that is
still open; redirects are judged by the request policy as columns and go into the next round. Every round is written
before the next begins, so a later failure asks no server twice; a task that is lost while it runs asks again. Limits are
checked per request: bytes while they are read, seconds over all hops, requests per feed. Nothing raises for one bad
request: its row says why.

A transport is a picklable function (url, headers, seconds, most_bytes, peer_allowed) to (status, headers, payload); it
calls peer_allowed with the address it is connected to before it sends anything.
"""

from __future__ import annotations

import http.client
import ipaddress
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import urls
from feedweave.operators import policy as rules
from feedweave.sources.responses import MAX_RESPONSE_BYTES
from feedweave.sources.shared import written

PER_HOST = 4
REDIRECTS = (301, 302, 303, 307, 308)
Transport = Callable[[str, dict, float, int, Callable[[str], None]], tuple[int, dict, bytes]]


class Refused(ValueError):
    """A request that must not go on; its text is the row's error."""


@dataclass(frozen=True)
class Limits:
    """What a feed may ask for; seconds count over all hops of a request."""

    max_requests: int = 1
    max_redirects: int = 5
    max_bytes: int = MAX_RESPONSE_BYTES
    seconds: float = 30.0
    allow_private: bool = False
    allow_cross_origin: bool = False
    headers: dict = field(default_factory=dict)


def over_http(url: str, headers: dict, seconds: float, most: int, peer_allowed: Callable[[str], None]) -> tuple[int, dict, bytes]:
    """One GET without redirects; the body is read up to most bytes."""
    u = urlsplit(url)
    kind = http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection
    connection, until = kind(u.hostname or "", u.port, timeout=seconds), time.monotonic() + seconds
    try:
        connection.connect()
        peer_allowed(connection.sock.getpeername()[0])
        connection.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers=headers)
        got, body = connection.getresponse(), bytearray()
        while part := got.read1(1 << 16):
            body += part
            if len(body) > most:
                raise Refused("response_too_large")
            if time.monotonic() > until:
                raise Refused("timeout")
        return got.status, dict(got.getheaders()), bytes(body)
    finally:
        connection.close()


def recorded(rows: dict[str, tuple[int, dict, bytes]]) -> Transport:
    """A transport that answers from a recording; what is not in it is connection_failed."""

    def answer(url: str, headers: dict, seconds: float, most: int, peer_allowed: Callable[[str], None]) -> tuple[int, dict, bytes]:
        if url not in rows:
            raise OSError("not recorded")
        return rows[url]

    return answer


def _public(address: str) -> None:
    try:
        a = ipaddress.ip_address(address.split("%")[0])
    except ValueError:
        raise Refused("private_network") from None
    nets = rules.BLOCKED_V4 if a.version == 4 else rules.BLOCKED_V6
    if any(a in ipaddress.ip_network(n) for n in nets):
        raise Refused("private_network")


HOP = pa.schema([("request", pa.int64()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string()), ("took", pa.float64())])
HOP_DDL = "request long, status int, headers map<string,string>, payload binary, error string, took double"


def _hop(open_: DataFrame, transport: Transport, limits: Limits) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = (lambda _: None) if limits.allow_private else _public
        for b in batches:
            for request, url, spent in zip(*[c.to_pylist() for c in b.columns], strict=True):
                status = headers = payload = error = None
                began = time.monotonic()
                try:
                    status, headers, payload = transport(url, limits.headers, limits.seconds - spent, limits.max_bytes, allowed)
                    if len(payload) > limits.max_bytes:
                        payload, error = None, "response_too_large"
                except Refused as e:
                    error = str(e)
                except TimeoutError:
                    error = "timeout"
                except (OSError, http.client.HTTPException, ValueError):
                    error = "connection_failed"
                row = (request, status, None if headers is None else list(headers.items()), payload, error, time.monotonic() - began)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, HOP, strict=True)], schema=HOP)

    spread = F.pmod(F.xxhash64("url"), F.lit(PER_HOST))
    dealt = open_.repartition(urls.part(F.col("url"), "host"), spread)
    return dealt.select("request", "url", "spent").mapInArrow(run, HOP_DDL)


def fetch(requests: DataFrame, transport: Transport = over_http, limits: Limits | None = None) -> DataFrame:
    """requests (feed_id, url; origin and relation if they follow from a page) to raw rows with final_url, hops and error.

    Raw rows (feed_id, url, status, headers, payload) are what sources.responses reads. Errors: those of the request policy,
    request_budget_exceeded, too_many_redirects, response_too_large, timeout, connection_failed; without one, null. A
    request for a null or empty URL is denied like one for a local name.
    """
    limits = limits or Limits()
    options = {"allow_private": limits.allow_private, "allow_cross_origin": limits.allow_cross_origin}
    origin = F.col("origin") if "origin" in requests.columns else F.col("url")
    relation = F.coalesce("relation", F.lit("initial")) if "relation" in requests.columns else F.lit("initial")
    asked = requests.select("feed_id", "url", F.coalesce(origin, F.col("url")).alias("origin"), relation.alias("relation"))
    place = F.row_number().over(Window.partitionBy("feed_id").orderBy((F.col("relation") != "initial").cast("int"), "url"))
    asked = written(asked.select("*", place.alias("place"), F.monotonically_increasing_id().alias("request")), "requests")
    why = F.when(F.col("place") > limits.max_requests, "request_budget_exceeded").otherwise(rules.denial(F.col("url"), F.col("origin"), F.col("relation"), **options))
    current = asked.select("request", "url", "origin", "relation", F.lit(0).alias("hops"), F.lit(0.0).alias("spent"), why.alias("error"))
    none = {"status": "int", "headers": "map<string,string>", "payload": "binary"}
    done: list[DataFrame] = []
    for hop in range(limits.max_redirects + 1):
        done.append(current.where("error is not null").select("request", F.col("url").alias("final_url"), "hops", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "error"))
        open_ = current.where("error is null").drop("error")
        got = written(open_.join(_hop(open_, transport, limits), "request"), "hop")
        location = F.get(F.map_values(F.map_filter("headers", lambda k, _: F.lower(k) == "location")), F.lit(0))
        moves = F.col("error").isNull() & F.col("status").isin(*REDIRECTS) & (F.coalesce(location, F.lit("")) != "")
        done.append(got.where(~moves).select("request", F.col("url").alias("final_url"), "hops", *none, "error"))
        left = got.where(moves).withColumn("_to", urls.resolve(F.trim(location), F.col("url")))
        time_left = F.when(F.col("spent") + F.col("took") >= limits.seconds, "timeout")
        last = F.lit("too_many_redirects" if hop == limits.max_redirects else None).cast("string")
        judged = F.coalesce(last, time_left, rules.redirect_denial(F.col("url"), F.col("_to"), F.col("origin"), F.col("relation"), **options))
        current = left.select("request", F.col("_to").alias("url"), "origin", "relation", (F.col("hops") + 1).alias("hops"), (F.col("spent") + F.col("took")).alias("spent"), judged.alias("error"))
        current = written(current, "redirects")
        if current.isEmpty():
            break
    done.append(current.where("error is not null").select("request", F.col("url").alias("final_url"), "hops", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "error"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return asked.select("request", "feed_id", "url").join(out, "request").drop("request")


def store(transport: Transport = over_http, limits: Limits | None = None) -> Callable[[DataFrame], DataFrame]:
    """A store for paging.follow and paging.crawl that fetches what is asked for: url, body, content_type, error."""
    from feedweave.sources.responses import responses

    def ask(requests: DataFrame) -> DataFrame:
        raw = written(fetch(requests, transport, limits), "raw")
        failed = raw.where("error is not null").select("url", F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("content_type"), "error")
        return responses(raw.where("error is null")).select("url", "body", "content_type", "error").unionByName(failed)

    return ask


#: Errors that no other transport can mend: the policy's own.
HARD_ERRORS = ("unsupported_url_scheme", "cross_origin_follow_up", "private_network", "request_budget_exceeded", "response_too_large")


def with_fallback(requests: DataFrame, transports: dict[str, Transport], items_of: Callable[[DataFrame], DataFrame], limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """Tries transports in order on feeds that have no items yet: attempts (feed_id, rank, strategy, items, error) and the raw rows of the first success.

    items_of(raw rows) gives feed_id, items. A hard error ends a feed's attempts.
    """
    attempts, kept = [], []
    open_ = requests
    for rank, (name, transport) in enumerate(transports.items()):
        raw = written(fetch(open_, transport, limits), "raw")
        counted = items_of(raw.where("error is null")).select("feed_id", F.col("items").cast("long").alias("items"))
        tried = raw.select("feed_id", "error").join(counted, "feed_id", "left").groupBy("feed_id").agg(F.max(F.coalesce("items", F.lit(0).cast("long"))).alias("items"), F.max("error").alias("error"))
        tried = written(tried.select("feed_id", F.lit(rank).alias("rank"), F.lit(name).alias("strategy"), "items", "error"), "attempt")
        attempts.append(tried)
        kept.append(raw.join(tried.where("items > 0").select("feed_id"), "feed_id", "left_semi"))
        over = tried.where((F.col("items") > 0) | F.coalesce(F.col("error").isin(*HARD_ERRORS), F.lit(False)))
        open_ = open_.join(over.select("feed_id"), "feed_id", "left_anti")
    both = []
    for parts in (attempts, kept):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        both.append(out)
    return both[0], both[1]
