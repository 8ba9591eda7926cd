"""Stored raw responses as a source: body decompression, charset decoding, content kinds and the response guard.

Raw rows are (feed_id, url, status, headers map, payload binary). Bodies are decoded in one Arrow pass; limits, kinds and
interstitial pages are column expressions, so rows a guard rejects can be dropped before any page is parsed. Errors are a
column, not an exception: one bad response does not stop the others.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.functions import texts

#: Limits in bytes, how much of a page is searched for its charset, and the two patterns.
MAX_RESPONSE_BYTES = 5_242_880
MAX_DECOMPRESSED_BYTES = 10_485_760
META_BYTES = 2048
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
HTML = re.compile(rb"\s*(?:<!DOCTYPE\s+html|<html)", re.I)


class TooLarge(ValueError):
    """A body beyond the limit after decompression."""


def _inflated(raw: bytes, bits: int, limit: int) -> bytes:
    """All members of a stream, never more than limit bytes in memory."""
    out = bytearray()
    while raw:
        engine = zlib.decompressobj(bits)
        out += engine.decompress(raw, limit + 1 - len(out))
        if len(out) > limit:
            raise TooLarge(f"decompressed body exceeds {limit} bytes")
        if not engine.eof:
            raise zlib.error("truncated stream")
        raw = engine.unused_data if bits > 15 and engine.unused_data[:2] == b"\x1f\x8b" else b""
    return bytes(out)


def decompressed(raw: bytes, encodings: str | None, limit: int = MAX_DECOMPRESSED_BYTES) -> bytes:
    """Undo the listed encodings, last first. Unlisted gzip is known by its first bytes. What fails to decode stays as it is.

    Brotli has no decoder here: the body stays as it is, and the caller sees no page in it.
    """
    listed = [e.strip().lower() for e in (encodings or "").split(",") if e.strip()]
    if not listed:
        return _inflated(raw, 31, limit) if raw[:2] == b"\x1f\x8b" else raw
    for encoding in reversed(listed):
        for bits in {"gzip": (31,), "deflate": (15, -15)}.get(encoding, ()):
            try:
                raw = _inflated(raw, bits, limit)
                break
            except zlib.error:
                continue
    return raw


def charset_of(raw: bytes, content_type: str | None) -> str | None:
    """The header's charset, else one named in the first META_BYTES of the page."""
    found = CHARSET.search((content_type or "").encode()) or CHARSET.search(raw[:META_BYTES])
    return found[1].decode("ascii", "replace") if found else None


def decoded(raw: bytes, content_type: str | None) -> str:
    """Text in the named charset; UTF-8 with replacement characters if there is none, it is unknown or does not fit."""
    name = charset_of(raw, content_type)
    try:
        if name and codecs.lookup(name).name != "utf-8":
            return raw.decode(name)
    except (LookupError, UnicodeDecodeError):
        pass
    return raw.decode("utf-8", "replace")


def kind_of(raw: bytes, content_type: str | None) -> str | None:
    """text/html by header or look, application/json by header, else None."""
    kind = content_type or ""
    json_like = "application/json" in kind
    if "text/html" in kind or (not json_like and HTML.match(raw)):
        return "text/html"
    return "application/json" if json_like else None


def _header(name: str) -> Column:
    """A header's value whatever the case of its name."""
    return F.get(F.map_values(F.map_filter("headers", lambda k, _: F.lower(k) == name)), F.lit(0))


OUT = pa.schema([("feed_id", pa.int64()), ("url", pa.string()), ("body", pa.string()), ("content_type", pa.string()), ("error", pa.string())])


def responses(raw: DataFrame, *, max_response_bytes: int = MAX_RESPONSE_BYTES, max_decompressed_bytes: int = MAX_DECOMPRESSED_BYTES) -> DataFrame:
    """Raw rows to (feed_id, url, body, content_type, error); body is null where error is not.

    Errors: response_too_large, decompressed_too_large, bad_encoding, unsupported_content_type, blocked_surface. A null
    payload counts as empty and has an unsupported type unless a header names one.
    """
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    # a body beyond the limit does not leave the JVM
    fit = F.when(size <= max_response_bytes, F.coalesce("payload", F.lit(b"")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, kinds, errors = [], [], []
            for payload, encoding, content_type in zip(*[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                body = kind = error = None
                try:
                    if payload is None:
                        error = "response_too_large"
                    else:
                        plain = decompressed(payload, encoding, max_decompressed_bytes)
                        kind = kind_of(plain, content_type)
                        error = None if kind else "unsupported_content_type"
                        body = decoded(plain, content_type) if kind else None
                except TooLarge:
                    error = "decompressed_too_large"
                except zlib.error:
                    error = "bad_encoding"
                bodies.append(body)
                kinds.append(kind)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bodies, pa.string()), pa.array(kinds, pa.string()), pa.array(errors, pa.string())], schema=OUT)

    cols = [F.col("feed_id").cast("long"), "url", fit.alias("payload"), _header("content-encoding").alias("encoding"), _header("content-type").alias("content_type")]
    got = raw.select(*cols).mapInArrow(run, "feed_id long, url string, body string, content_type string, error string")
    blocked = F.col("error").isNull() & (F.col("content_type") == "text/html") & texts.interstitial(F.col("body")).isNotNull()
    error = F.when(blocked, "blocked_surface").otherwise(F.col("error"))
    return got.select("feed_id", "url", F.when(error.isNull(), F.col("body")).alias("body"), "content_type", error.alias("error"))


def local_files(spark: SparkSession, path: str, url: str | None = None) -> DataFrame:
    """Files of any Spark path as raw rows with status 200 and type text/html; feed_id is a hash of the file's path."""
    files = spark.read.format("binaryFile").load(path)
    headers = F.create_map(F.lit("content-type"), F.lit("text/html"))
    return files.select(F.xxhash64("path").alias("feed_id"), (F.lit(url) if url else F.col("path")).alias("url"), F.lit(200).alias("status"), headers.alias("headers"), F.col("content").alias("payload"))
