"""Best-fit packing (operator 5): sum-of-squares packing.

Texts become pieces of at most CAPACITY tokens. A piece goes to the open sequence for which the sum over residual gaps of
the squared number of open sequences with that gap becomes smallest (a new sequence is one of the choices; ties: the
tightest). Then, REOPEN times, the sequences with most room (a fifth, a tenth in every other round) are opened again and
their pieces placed anew by the same rule among the others' gaps, if that takes no more sequences. Pieces are dealt evenly over groups of about GROUP pieces whatever their ids or
lengths; each group is packed by one task, long pieces first. Its sequences that stay open are then pieces themselves: FAN groups at a time meet in the
next round, up to one last group, so open ends do not grow with the number of groups.

Memory: one batch of texts while tokenizing, the gap counts and one group's pieces while packing. Defined cases: null
text counts as empty and is a piece of one token (the end id 0); null ids are rows; repeated rows are packed each;
an empty table gives an empty result; extra columns are not read by the query.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import documents, materialize
from feedweave.llm.word_tokens import tokens

CAPACITY = 2048
END = 0
GROUP = 16_384
FAN = 64
BATCH_CHARS = 4_000_000
REOPEN = 6


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY, filled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each length, in the order given, and how full each bin is then; bins that are there already hold filled."""
    counts = np.zeros(capacity + 1, np.int64)  # open bins per gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = [] if filled is None else filled.tolist()
    for bin_, full in enumerate(used):
        if full < capacity:
            bins[capacity - full].append(bin_)
            counts[capacity - full] += 1
    where = np.empty(len(lengths), np.int64)
    huge = np.int64(2**62)
    for k, size in enumerate(lengths.tolist()):
        best = None
        if size < capacity:
            # from gap g to gap g - size: the squares change by 2 (N[g - size] - N[g] + 1), a full bin leaves the sum
            have = counts[size:capacity]
            change = -2 * have + 1
            change[1:] += 2 * counts[1 : capacity - size] + 1
            change[have == 0] = huge
            g = int(change.argmin()) if len(change) else 0
            if len(change) and change[g] < huge and change[g] <= 2 * counts[capacity - size] + 1:
                best = g + size
        if best is None:
            bin_, gap = len(used), capacity
            used.append(0)
        else:
            bin_, gap = bins[best].pop(), best
            counts[best] -= 1
        where[k] = bin_
        used[bin_] += size
        left = gap - size
        if left:
            bins[left].append(bin_)
            counts[left] += 1
    return where, np.array(used, np.int64)


def reopened(lengths: np.ndarray, capacity: int = CAPACITY, rounds: int = REOPEN) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length: the rule, then again for the pieces of the bins with most room."""
    where, used = sum_of_squares(lengths, capacity)
    for r in range(rounds):
        poor = np.argsort(used, kind="stable")[: max(1, len(used) // (10 if r % 2 else 5))]
        poor = poor[used[poor] < capacity]
        again, kept = np.isin(where, poor), np.setdiff1d(np.arange(len(used)), poor)
        placed, full = sum_of_squares(lengths[again], capacity, used[kept])
        if not again.any() or len(full) > len(used):
            break
        where[~again] = np.searchsorted(kept, where[~again])
        where[again], used = placed, full
    order = np.argsort(where, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    starts = np.cumsum(used) - used
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - starts[where[order]]
    return where, offset


PIECE_DDL = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, deal long{extra}"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, *, with_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, deal (a running number that spreads rows), and ids if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, deal = tokens(path), TaskContext.get().partitionId() << 33  # room for every piece of a task
        for b in batches:
            sizes = np.cumsum(pd.Series(b.column(1).to_pylist(), dtype=object).fillna("").str.len().to_numpy(np.int64))
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS)))
                part = b.slice(at, end - at)
                keys, number, start, length, crc, body = [], [], [], [], [], []
                for row, ids in enumerate(encode([x or "" for x in part.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for k in range(0, len(ids), capacity):
                        cut = ids[k : k + capacity]
                        keys.append(row)
                        number.append(k // capacity)
                        start.append(k)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        body.append(cut)
                cols = [part.column(0).take(pa.array(keys)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(range(deal, deal + len(keys)), pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
                if with_ids:
                    cols.append(pa.array([x.tolist() for x in body], pa.list_(pa.int32())))
                    names.append("ids")
                deal += len(keys)
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at = end

    ddl = PIECE_DDL.format(kind=kind, extra=", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def pack(table: DataFrame, n: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """table (with deal and length, n rows) plus sequence_id and offset."""
    groups = max(1, math.ceil(n / group))
    dealt = table.withColumn("_g", F.pmod(F.xxhash64("deal"), F.lit(groups)))
    schema = "deal long, length long, bin long, offset long, used long"

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "deal"], ascending=[False, True], kind="stable")
        where, offset = reopened(pdf["length"].to_numpy(), capacity)
        used = np.bincount(where, pdf["length"].to_numpy()).astype(np.int64) if len(where) else np.empty(0, np.int64)
        first = pdf["deal"].to_numpy()[np.unique(where, return_index=True)[1]] if len(where) else np.empty(0, np.int64)
        return pd.DataFrame({"deal": pdf["deal"].to_numpy(), "length": pdf["length"].to_numpy(), "bin": first[where], "offset": offset, "used": used[where]})

    # a bin is named by the deal number of its first piece; that number also names the open bin as a piece of the next round
    placed = materialize(dealt.select("_g", "deal", "length").groupBy("_g").applyInPandas(packed, schema), "placed")
    moves = None
    width = groups
    level_rows = placed
    while width > 1:
        width = math.ceil(width / FAN)
        open_ = level_rows.where((F.col("used") < capacity) & (F.col("offset") == 0)).select(F.col("bin").alias("deal"), F.col("used").alias("length"))
        step = open_.withColumn("_g", F.pmod(F.xxhash64("deal", F.lit(width)), F.lit(width)))
        level_rows = materialize(step.groupBy("_g").applyInPandas(packed, schema), "placed")
        move = level_rows.select(F.col("deal").alias("old"), F.col("bin").alias("new"), F.col("offset").alias("shift"))
        if moves is None:
            moves = move
        else:
            joined = moves.alias("a").join(move.alias("b"), F.col("a.new") == F.col("b.old"), "left")
            moves = joined.select("a.old", F.coalesce("b.new", "a.new").alias("new"), (F.col("a.shift") + F.coalesce("b.shift", F.lit(0))).alias("shift"))
    bins = placed.select("deal", "bin", "offset")
    if moves is not None:
        bins = bins.join(moves, bins["bin"] == moves["old"], "left").select("deal", F.coalesce("new", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return table.join(bins, "deal").withColumnRenamed("bin", "sequence_id").drop("deal")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    table = materialize(pieces(docs, path or tokenizer_path()), "pieces")
    return pack(table, table.count()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents and their places."""
    return packed_documents(docs)
