"""Byte-level BPE against the rank-file library and against exact round trips."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from feedweave.llm import byte_bpe


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.rank_file(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [None, "", " ", "\n \t\n", "h\u00e9llo \u6f22\u5b57 \U0001f600x", "don't  we'll", "<|endoftext|>", "\x00\x01\x85\xa0\u200b\u3000", "e\u0301" * 5, "a" * 4000, "-=" * 3000, "\u00df\u01c5\u0660\u2167"]


def test_ids_equal_the_library(library):
    coder, rng = byte_bpe.bpe(byte_bpe.rank_file(), byte_bpe.split_pattern()), random.Random(5)
    parts = ["a", " ", "-", "=", "\n", "\u00e9", "\u6f22", "\U0001f600", "1", "'s", "th", "the", "_", "\t", "\xa0", "ing", " a"]
    texts = ["".join(rng.choice(parts) * rng.choice([1, 1, 2, 5]) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode_ordinary(x) for x in texts]


def test_every_character_splits_alike(library):
    coder = byte_bpe.bpe(byte_bpe.rank_file(), byte_bpe.split_pattern())
    texts = [f"a{c}1{c} {c}{c}.{c} b" for c in (chr(i) for i in range(0, 0x30000, 3) if not 0xD800 <= i < 0xE000)]
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode_ordinary(x) for x in texts]


def test_rows(spark, library):
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x") for i, t in enumerate(ODD + ODD[4:6])], "doc_id long, text string, ids string")
    got = byte_bpe.digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = []
    for i, t in enumerate(ODD + ODD[4:6]):
        ids = library.encode_ordinary(t or "")
        want.append((i if i % 5 else None, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert byte_bpe.digests(docs.limit(0)).count() == 0


def test_offsets_and_text(spark, library):
    rows = spark.createDataFrame([(t,) for t in ODD], "text string").select("text", byte_bpe.encode(F.col("text")).alias("e"))
    for r in rows.select("text", "e.*", byte_bpe.decode(F.col("e.ids")).alias("back")).collect():
        text, at = r.text or "", 0
        bounds = [len(text[:i].encode()) for i in range(len(text) + 1)]
        split = set()
        for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            size = len(library.decode_single_token_bytes(i))
            assert bounds[a] <= at < bounds[a + 1] and bounds[b - 1] < at + size <= bounds[b]
            split |= {a} if at > bounds[a] else set()
            split |= {b - 1} if at + size < bounds[b] else set()
            at += size
        assert at == bounds[-1] and r.back.text == text and bytes(r.back.bytes) == text.encode() and r.back.n_split == len(split)


def test_cut_and_unknown_ids(spark):
    coder = byte_bpe.bpe(byte_bpe.rank_file(), byte_bpe.split_pattern())
    ids = coder.encode(["\u6f22"])[0].tolist()
    assert len(ids) > 1
    rows = spark.createDataFrame([(ids,), (ids[:-1],), ([50256],), ([-1],), ([None],), (None,), ([],)], "ids array<int>")
    got = [r.d for r in rows.select(byte_bpe.decode(F.col("ids")).alias("d")).collect()]
    assert got[0].text == "\u6f22" and got[0].n_split == 1
    assert got[1].text == "\ufffd" and bytes(got[1].bytes) == "\u6f22".encode()[: len(bytes(got[1].bytes))]
    assert [g.bytes for g in got[2:6]] == [None] * 4 and bytes(got[6].bytes) == b""
