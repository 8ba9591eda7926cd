"""LM scoring (operator 4): prediction by partial matching, trained on the corpus, and a word unigram base.

No node of the trie is left out at any size, and nothing is broadcast but the counts of byte pairs (65,536 at most).

1. Scan. Every task cuts its texts into blocks of BLOCK_BYTES and lists a block's different (context, byte) keys of the
   highest order and its different words, each with the count in the block's training texts (zero where only held-out
   texts have it). Lists are dealt to slices, by the last two bytes of a context or the hash of a word.
2. Slices. All blocks' lists of one slice meet: their counts add up to the slice's part of the trie (all orders from two
   on of these contexts) or of the vocabulary, and every block gets its answers in its own order: the log10 probability of
   each key, the corpus count of each word. The number of slices follows the input's size (SLICE_BYTES).
3. Blocks. A block's texts and its answers meet and its documents are scored; the document's own counts come in here. The
   texts come in the scan's order, which gives their words the same places again.

A word is known by a 128-bit hash, so that no two words meet. Common keys and words are one entry per block and list, so
no slice grows with a key's frequency.

Defined cases: null text counts as empty (its end is still a token); a null id is in training; empty tables give empty
results; repeated rows are scored, and trained on, each; without training texts all bytes are equally likely; one very
long text is a block of its own; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm import ppm
from feedweave.llm.common import discard_part, documents, materialize

BLOCK_BYTES = 12_000_000
SLICE_BYTES = 32_000_000
CHUNK = 1_000_000  # bytes counted or scored at once
END_WORD = b"\n"  # no word holds white space
NODES, WORDS, TEXTS, PAIRS = 0, 1, 2, 3
ROW_DDL = "kind int, slice int, block long, doc_id long, held_out boolean, a binary, b binary, c binary"
ROW = pa.schema([("kind", pa.int32()), ("slice", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) + ppm.ORDER + 1
        if n >= CHUNK:
            yield part
            part, n = [], 0
    if part:
        yield part


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _places(text: bytes, place: dict[bytes, int]) -> np.ndarray:
    """The places of a text's words and end; new words get the next places, so the same texts in the same order give the same."""
    found = [place.setdefault(w, len(place)) for w in text.lower().split()]
    found.append(place.setdefault(END_WORD, len(place)))
    return np.array(found, "<u4")


def _rows(kind: int, cols: dict) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, f.type) if f.name == "kind" else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in ROW], schema=ROW)


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """By the last two bytes of the context: all nodes of orders two and more below them are in one slice."""
    return (((keys >> 8 & 0xFFFF) * 0x9E3779B1) >> 16) % slices


class _Block:
    """Texts of one block with what they ask for: keys and words, in the order in which they are packed."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes, self.count, self.size = number, 0, 0, 0
        self.place: dict[bytes, int] = {}
        self.tf = np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes], held: list[bool]) -> list[int]:
        """Count some texts; their numbers within the block."""
        place = self.place
        ids = [_places(t, place) for t in texts]
        trained = [x for x, out in zip(ids, held, strict=True) if not out]
        tf = np.bincount(np.concatenate(trained), minlength=len(place)) if trained else np.zeros(len(place), np.int64)
        tf[: len(self.tf)] += self.tf
        self.tf = tf
        for out in (False, True):
            for chunk in _chunks([t for t, x in zip(texts, held, strict=True) if x == out]):
                keys, n = ppm.count(ppm.spread(chunk)[0])
                self.parts.append((keys, np.zeros_like(n) if out else n))
                self.size += len(keys)
        if len(self.parts) > 1 and self.size > 2 * len(self.parts[0][0]) + 500_000:  # as much has come as there was
            self.parts = [ppm.merge(self.parts)]
            self.size = len(self.parts[0][0])
        self.bytes += sum(map(len, texts)) + len(texts)
        self.count += len(texts)
        return list(range(self.count - len(texts), self.count))

    def lists(self, slices: int) -> Iterator[pa.RecordBatch]:
        keys, n = ppm.merge(self.parts)
        part = _slice_of(keys, slices)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(slices + 1))
        own = [s for s in range(slices) if cuts[s] < cuts[s + 1]]
        groups = [order[cuts[s] : cuts[s + 1]] for s in own]
        yield _rows(NODES, {"slice": own, "block": [self.number] * len(own), "a": [_pack(np.diff(keys[g], prepend=0)) for g in groups], "b": [_pack(n[g].astype("<i8")) for g in groups]})
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.place)), "<i8").reshape(-1, 2)
        part = (h[:, 0] & 0x7FFFFFFF) % slices
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(slices + 1))
        own = [s for s in range(slices) if cuts[s] < cuts[s + 1]]
        groups = [order[cuts[s] : cuts[s + 1]] for s in own]
        # c: the words' places in the block, so that answers find back
        yield _rows(WORDS, {"slice": own, "block": [self.number] * len(own), "a": [h[g].tobytes() for g in groups], "b": [_pack(self.tf[g].astype("<i8")) for g in groups], "c": [_pack(g.astype("<i4")) for g in groups]})
        pairs, m = np.unique(keys & 0xFFFF, return_inverse=True)
        sums = np.bincount(m, n, minlength=len(pairs)).astype("<i8")
        yield _rows(PAIRS, {"a": [pairs[sums > 0].astype("<i4").tobytes()], "b": [sums[sums > 0].tobytes()]})


def _scan(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId() << 24)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                texts = [(t.as_py() or "").encode() for t in b.column(1)]
                held = [held_out(i) for i in b.column(0).to_pylist()]
                numbers = block.add(texts, held)
                yield _rows(TEXTS, {"slice": numbers, "block": [block.number] * len(texts), "doc_id": b.column(0).to_pylist(), "held_out": held, "a": [zstandard.compress(t, 3) for t in texts]})
                if block.bytes >= BLOCK_BYTES:
                    yield from block.lists(slices)
                    block = _Block(block.number + 1)
        if block.parts:
            yield from block.lists(slices)

    return run


ANSWER = "kind int, block long, doc_id long, held_out boolean, a binary, b binary, tokens long, types long"


def _answers(kind: int, block: pd.Series, a: pd.Series, b: list[bytes], tokens: int = 0, types: int = 0) -> pd.DataFrame:
    """tokens and types of the slice stand in its first row."""
    first = np.arange(len(b)) == 0
    return pd.DataFrame({"kind": kind, "block": block.to_numpy(), "doc_id": None, "held_out": None, "a": a.to_numpy(), "b": b, "tokens": first * tokens, "types": first * types})


def _answer(low):
    """A slice's lists, of all blocks, to one row of answers per block."""

    def nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [np.cumsum(_unpack(k, "<i8")) for k in pdf["a"]]
        keys, n = ppm.merge(list(zip(asked, (_unpack(x, "<i8") for x in pdf["b"]), strict=True)))
        known = n > 0
        levels = ppm.lower_orders(keys[known], n[known], ppm.ORDER)
        model = ppm.Model([*low.value, *levels[2:]])
        logs = model.code(keys).astype("<f4")
        body = [_pack(logs[np.searchsorted(keys, q)]) for q in asked]
        return _answers(NODES, pdf["block"], pdf["a"], body)

    def words(pdf: pd.DataFrame) -> pd.DataFrame:
        lens = [len(x) // 16 for x in pdf["a"]]
        h = np.frombuffer(b"".join(pdf["a"]), "<i8").reshape(-1, 2)
        ids = _pair_ids(h)
        tf = np.concatenate([_unpack(x, "<i8") for x in pdf["b"]])
        total = np.bincount(ids, tf).astype("<i8")
        cut = np.split(total[ids], np.cumsum(lens)[:-1])
        return _answers(WORDS, pdf["block"], pdf["c"], [_pack(x) for x in cut], int(tf.sum()), int((total > 0).sum()))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        return nodes(pdf) if key[0] == NODES else words(pdf)

    return run


def _pair_ids(h: np.ndarray) -> np.ndarray:
    """A number for each different row of two longs."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]).any(1)))
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"


def _score_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's texts and answers to its documents' sums."""
    asked = pdf[pdf["kind"] == NODES]
    keys = np.concatenate([np.cumsum(_unpack(x, "<i8")) for x in asked["a"]])
    logs = np.concatenate([_unpack(x, "<f4") for x in asked["b"]]).astype(np.float64)
    find = pd.Index(keys).get_indexer
    own = pdf[pdf["kind"] == WORDS]
    places = np.concatenate([_unpack(x, "<i4") for x in own["a"]])
    c = np.zeros(len(places), np.int64)
    c[places] = np.concatenate([_unpack(x, "<i8") for x in own["b"]])
    word_logs = np.log10(c + 1.0)
    docs = pdf[pdf["kind"] == TEXTS].sort_values("slice")
    texts = [zstandard.decompress(x) for x in docs["a"]]
    scores = []
    for chunk in _chunks(texts):
        at, owner, _ = ppm.spread(chunk)
        scores.append(np.bincount(owner, ppm.adapted(chunk, owner, logs[find(at)]), minlength=len(chunk)))
    place: dict[bytes, int] = {}
    ids = [_places(t, place) for t in texts]
    return pd.DataFrame(
        {
            "doc_id": docs["doc_id"].to_numpy(),
            "held_out": docs["held_out"].to_numpy(),
            "n_tokens": [len(x) for x in ids],
            "n_known": [int((c[x] > 0).sum()) for x in ids],
            "logs": [math.fsum(word_logs[x]) for x in ids],
            "score": np.concatenate(scores),
        }
    )


def slices_for(docs: DataFrame) -> int:
    """A slice for every SLICE_BYTES of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    return max(8, math.ceil((size or 0) / SLICE_BYTES))


def pair_counts(scanned: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Node counts of orders 0 and 1: at most 256 and 65,536."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                yield pd.DataFrame({"pair": np.frombuffer(a, "<i4"), "n": np.frombuffer(b, "<i8")})

    got = scanned.where(F.col("kind") == PAIRS).select("a", "b").mapInPandas(each, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").collect()
    one = np.array([r["pair"] for r in got], np.int64), np.array([r["n"] for r in got], np.int64)
    return ppm.lower_orders(*one, 1)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slices = slices_for(docs)
    scanned = materialize(docs.mapInArrow(_scan(slices), ROW_DDL), "scanned", ("kind",))
    low = spark.sparkContext.broadcast(pair_counts(scanned))
    lists = scanned.where(F.col("kind") <= WORDS).select("kind", "slice", "block", "a", "b", "c").repartition(2 * slices, "kind", "slice")
    answers = materialize(lists.groupBy("kind", "slice").applyInPandas(_answer(low), ANSWER), "answers")
    sums = materialize(answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")), "sums")
    discard_part(scanned, f"kind={NODES}", f"kind={WORDS}")  # answered
    texts = scanned.where(F.col("kind") == TEXTS).select("kind", "slice", "block", "doc_id", "held_out", "a", "b")
    each = texts.unionByName(answers.select("kind", "block", "doc_id", "held_out", "a", "b"), allowMissingColumns=True).groupBy("block").applyInPandas(_score_block, SCORED)
    total = each.crossJoin(F.broadcast(sums))  # one row
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.col("tokens") + F.col("types") + 1.0)
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.col("tokens").cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
