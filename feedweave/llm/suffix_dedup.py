"""Suffix-array dedup (operator 10): every byte under a LENGTH-byte string that also starts elsewhere goes.

A window is a string of LENGTH bytes inside one text. Which windows repeat is decided exactly, in three steps:

1. Pieces. Every window has a minimizer: of its GRAM-byte strings the one of least hash, the leftmost of equals. Equal
   windows have equal minimizers at equal places. Runs of windows with one minimizer are pieces, about one per 80 bytes.
   A piece whose bytes occur again repeats as a whole; one whose minimizer occurs nowhere else holds no repeat.
2. Cells. Different pieces of one minimizer lie at the ends of repeats. Each (of equal ones one) is cut at multiples of
   CELL bytes before the minimizer into cells: up to CELL windows that share a core of LENGTH - CELL + 1 bytes. With the core as one symbol a cell is a
   string of at most 2 * CELL - 1 symbols, its windows are its substrings of CELL symbols. Cells whose core is nowhere
   else hold no repeat.
3. Suffix arrays of the cells, those of one core in one array, by linear grouping over Lyndon prefixes (suffix_sort):
   a window repeats if its CELL symbols equal those of a neighbour in suffix order. Equal cells are one with a
   multiplicity. A core with more than HOT cells is too much for one task: it is split by the bytes beside it into cores
   of half the cell (windows that reach further left take the left bytes into their core, the others the right ones), and
   again until it fits or a cell is one window.

Texts are named by two hashes of their content; equal texts are one name, and all their pieces repeat. Whole texts meet
their marks in two joins; nothing is collected per group but the cells of one core (HOT at most) and the marks of one text.

Defined cases: null text counts as empty; texts under LENGTH bytes stay whole; repeated rows remove each other; null ids
are rows; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import discard, documents, materialize, plain_names, whole_text
from feedweave.llm.suffix_sort import suffix_array

LENGTH = 200
GRAM = 32
CELL = 16
HOT = 2048
CELLS_PER_BLOCK = 16_384
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _RNG.integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram bytes (a power of two) that start at each place, by doubling."""
    h, m, k = _BYTE[raw], 1, 0
    while m < gram:
        h = h[:-m] * _MULT[k] + h[m:]
        h ^= h >> np.uint64(29)
        m, k = 2 * m, k + 1
    return h


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash, the leftmost of equals, among width hashes from each place on."""
    low, at, m = h, np.arange(len(h)), 1
    while 2 * m <= width:
        right = low[m:] < low[:-m]
        low, at = np.where(right, low[m:], low[:-m]), np.where(right, at[m:], at[:-m])
        m *= 2
    if m < width:
        n, gap = len(h) - width + 1, width - m
        right = low[gap : gap + n] < low[:n]
        at = np.where(right, at[gap : gap + n], at[:n])
    return at


def pieces(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per piece: gram hash, first window, number of windows, minimizer's place."""
    if len(raw) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    at = minimizers(h, length - gram + 1)
    first = np.nonzero(np.concatenate(([True], at[1:] != at[:-1])))[0]
    place = at[first]
    return h[place].view(np.int64), first, np.diff(np.append(first, len(at))), place


PIECE = "h1 long, h2 long, gram long, piece long, s int, n int, a int"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def piece_rows(texts: DataFrame) -> DataFrame:
    """h1, h2, text to one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for off in range(0, whole.num_rows, 256):
                b = whole.slice(off, 256)
                h1, h2 = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                out: list[list] = [[] for _ in range(6)]
                body: list[int] = []
                for k, text in enumerate(b.column(2)):
                    raw = text.as_py().encode()
                    gram, s, n, a = pieces(raw)
                    if not len(s):
                        continue
                    for col, x in zip(out, (np.full(len(s), h1[k]), np.full(len(s), h2[k]), gram, s, n, a), strict=True):
                        col.append(x)
                    d = (a - s).tolist()
                    ends = (s + n + LENGTH - 1).tolist()
                    body += [xxhash.xxh3_64_intdigest(raw[x:y], seed=z) for x, y, z in zip(s.tolist(), ends, d, strict=True)]
                if body:
                    c = [np.concatenate(x) for x in out]
                    cols = [pa.array(c[0]), pa.array(c[1]), pa.array(c[2]), pa.array(np.array(body, np.uint64).view(np.int64)), *[pa.array(x.astype(np.int32)) for x in c[3:]]]
                    yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "gram", "piece", "s", "n", "a"])

    return texts.select("h1", "h2", "text").mapInArrow(run, PIECE)


CELL_ROW = "core long, core2 long, h1 long, h2 long, start int, high int, low int, left binary, right binary"


def cells(raw: bytes, s: int, n: int, a: int) -> Iterator[tuple]:
    """Cells of a piece: core's place and number k, least and largest j of its windows; window j starts at a - CELL * k - j."""
    far, near = a - s, a - (s + n - 1)
    for k in range(near // CELL, far // CELL + 1):
        low, high = max(near - CELL * k, 0), min(far - CELL * k, CELL - 1)
        core = a - CELL * k
        yield k, core, low, high, raw[core - high : core], raw[core + LENGTH - CELL + 1 : core + LENGTH - low]


def cell_rows(texts: DataFrame) -> DataFrame:
    """h1, h2, text, open (array of s, n, a) to one row per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h1, h2, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw = text.as_py().encode()
                for m in marks.as_py():
                    for k, core, low, high, left, right in cells(raw, m["s"], m["n"], m["a"]):
                        digest = xxhash.xxh3_128_intdigest(raw[core : core + LENGTH - CELL + 1], seed=k)
                        rows.append((_signed(digest >> 64), _signed(digest & (1 << 64) - 1), h1, h2, core, high, low, left, right))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CELL_ROW.split(", ")])

    return texts.select("h1", "h2", "text", "open").mapInArrow(run, CELL_ROW)


def repeated_windows(core: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[bytes], right: list[bytes], cell: int = CELL) -> np.ndarray:
    """For each cell the bits j of its windows that occur in another cell, by one suffix array over the different cells."""
    kinds: dict[tuple, int] = {}
    of = np.array([kinds.setdefault(x, len(kinds)) for x in zip(core.tolist(), low.tolist(), high.tolist(), left, right, strict=True)], np.int64)
    many = np.bincount(of) > 1 if len(of) else np.empty(0, bool)
    core, low, high = (np.array(x, np.int64) for x in list(zip(*kinds, strict=True))[:3]) if kinds else (of, of, of)
    sides = [(x[3], x[4]) for x in kinds]
    lens = high + 1 + (cell - 1 - low)
    ends = np.cumsum(lens + 1)
    starts = ends - lens - 1
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    text[:] = np.frombuffer(b"".join(x + b"\0" + y + b"\0" for x, y in sides), np.uint8)
    text += 1 + len(core)
    text[starts + high] = 1 + len(core) + 256 + core  # the core, one symbol
    text[ends - 1] = np.arange(len(core))  # a separator of its own after each cell
    count = high - low + 1
    owner_cell = np.repeat(np.arange(len(core)), count)
    within = np.arange(len(owner_cell)) - np.repeat(np.cumsum(count) - count, count)
    window = starts[owner_cell] + within  # its first window is the one that starts furthest left
    order = suffix_array(text)
    owner = np.full(len(text), -1, np.int64)
    owner[window] = np.arange(len(window))
    ranked = owner[order]
    ranked = ranked[ranked >= 0]
    at = window[ranked]
    same = np.ones(max(0, len(at) - 1), bool)
    for k in range(cell):
        same &= text[at[1:] + k] == text[at[:-1] + k]
    again = many[owner_cell]
    again[ranked[1:]] |= same
    again[ranked[:-1]] |= same
    bits = np.zeros(len(core), np.int64)
    j = high[owner_cell] - within
    np.bitwise_or.at(bits, owner_cell[again], np.int64(1) << j[again])
    return bits[of]


def halves(found: DataFrame, cell: int) -> DataFrame:
    """Cells of cell windows as cells of half as many, whose cores take the half bytes to the left or to the right in."""
    half = cell // 2
    side = lambda tag, body: {"core": F.xxhash64("core", "core2", F.lit(tag), body), "core2": F.xxhash64("core2", F.lit(tag), body, "core")}
    sub = lambda col, at, n: F.substring(F.col(col), at, n)
    reach = F.col("high") - half
    to_left = found.where(F.col("high") >= half).withColumns(
        side("left", sub("left", reach + 1, F.lit(half)))
        | {"high": reach, "low": F.greatest(F.col("low") - half, F.lit(0)), "shift": F.col("shift") + half, "left": sub("left", F.lit(1), reach), "right": sub("right", F.lit(1), half - 1 - F.greatest(F.col("low") - half, F.lit(0)))}
    )
    top = F.least(F.col("high"), F.lit(half - 1))
    to_right = found.where(F.col("low") < half).withColumns(
        side("right", sub("right", F.lit(1), F.lit(half))) | {"high": top, "left": sub("left", F.col("high") - top + 1, top), "right": sub("right", F.lit(half + 1), half - 1 - F.col("low"))}
    )
    return to_left.unionByName(to_right)


def _sorted(cell: int):
    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        core = pd.factorize(pd.MultiIndex.from_frame(pdf[["core", "core2"]]))[0]
        bits = repeated_windows(core, pdf["low"].to_numpy().astype(np.int64), pdf["high"].to_numpy().astype(np.int64), list(pdf["left"]), list(pdf["right"]), cell)
        return pdf[["h1", "h2", "start"]].assign(bits=bits << pdf["shift"].to_numpy().astype(np.int64))[bits > 0]

    return sort


def resolve(found: DataFrame, hot: int = HOT) -> tuple[DataFrame, list[DataFrame]]:
    """h1, h2, start, bits: the repeated windows of all cells; and the tables that they are read from."""
    tables = []
    schema = "h1 long, h2 long, start int, bits long"
    found = found.withColumn("shift", F.lit(0))
    cell, out = CELL, None
    while True:
        found = materialize(found, "cells")
        per = materialize(found.groupBy("core", "core2").agg(F.count("*").alias("cells")).where("cells > 1"), "cores")
        shared = materialize(found.join(per, ["core", "core2"]), "shared")
        discard(found)
        tables += [per, shared]
        few = shared.where(F.col("cells") <= hot) if cell > 1 else shared
        if cell > 1:
            total, large = per.agg(F.sum(F.when(F.col("cells") <= hot, F.col("cells"))), F.max("cells")).first()
            blocks = max(1, -(-int(total or 0) // CELLS_PER_BLOCK))
            dealt = few.withColumn("_g", F.pmod(F.xxhash64("core", "core2"), F.lit(blocks)))

            # a number of partitions of its own: blocks are not put together into long tasks
            got = dealt.select("_g", "core", "core2", "h1", "h2", "start", "high", "low", "shift", "left", "right").repartition(blocks, "_g").groupBy("_g").applyInPandas(_sorted(cell), schema)
        else:  # a cell is one window, and its core the whole of it
            large, got = 0, few.select("h1", "h2", "start", F.expr("shiftleft(1L, shift)").alias("bits"))
        out = got if out is None else out.unionByName(got)
        if (large or 0) <= hot:
            return out, tables
        found, cell = halves(shared.where(F.col("cells") > hot).drop("cells"), cell), cell // 2


OUT = "doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def spans_of(n: int, whole: list[tuple[int, int]], marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Removed spans of a text of n bytes: windows [s, s + count) that repeat, and cells with bits."""
    runs = [(s, s + c - 1 + LENGTH) for s, c in whole]
    for start, bits in marks:
        runs += [(start - j, start - j + LENGTH) for j in range(CELL) if bits >> j & 1]
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", whole_text()).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(LENGTH))})


def marked(docs: DataFrame) -> DataFrame:
    """named(docs) plus whole (array of s, n) and bits (array of start, bits) of its repeated windows; null where there are none."""
    texts = named(docs)
    rows = materialize(piece_rows(texts), "pieces")
    # counts combine before they are shuffled and meet the rows in joins, which adaptive execution splits: no common
    # minimizer or piece meets whole in one task. Counts are written first, as a join right on top of an aggregate is
    # not split
    grams = rows.groupBy("gram").agg(F.count("*").alias("grams"), (F.min("piece") < F.max("piece")).alias("differ")).where("grams > 1").drop("grams")
    grams = materialize(grams, "grams")
    again = materialize(rows.join(grams, "gram"), "again")
    discard(rows, grams)
    first = F.min(F.struct("h1", "h2", "s", "n", "a")).alias("first")
    kinds = materialize(again.groupBy("gram", "piece").agg(F.count("*").alias("same"), F.any_value("differ").alias("differ"), first), "kinds")
    # a piece is compared by cells if its minimizer has other pieces; of equal ones the first stands for all
    compared = kinds.where("differ").select("first.*")
    # equal texts have equal pieces
    repeated = again.select("h1", "h2", "gram", "piece", "s", "n").join(kinds.where("same > 1").select("gram", "piece"), ["gram", "piece"]).select("h1", "h2", "s", "n").distinct()
    open_ = materialize(compared.groupBy("h1", "h2").agg(F.collect_list(F.struct("s", "n", "a")).alias("open")), "open")
    once = texts.select("h1", "h2", "text").join(open_, ["h1", "h2"]).groupBy("h1", "h2").agg(F.any_value("text").alias("text"), F.any_value("open").alias("open"))
    bits, tables = resolve(cell_rows(once))
    bits = bits.groupBy("h1", "h2", "start").agg(F.bit_or("bits").alias("bits"))
    whole = repeated.select("h1", "h2", F.struct(F.col("s").alias("at"), F.col("n").cast("long").alias("v"), F.lit(False).alias("cell")).alias("m"))
    part = bits.select("h1", "h2", F.struct(F.col("start").alias("at"), F.col("bits").alias("v"), F.lit(True).alias("cell")).alias("m"))
    found = materialize(whole.unionByName(part).groupBy("h1", "h2").agg(F.collect_list("m").alias("marks")), "marks")
    discard(again, kinds, open_, *tables)
    return texts.join(found, ["h1", "h2"], "left")


def _removed(raw: bytes, marks: list | None) -> list[tuple[int, int]]:
    marks = marks or ()
    return spans_of(len(raw), [(m["at"], m["v"]) for m in marks if not m["cell"]], [(m["at"], m["v"]) for m in marks if m["cell"]])


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def digests(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, spans, sha = [], [], [], []
            for text, marks in zip(b.column(1), b.column(2), strict=True):
                raw = text.as_py().encode()
                cut = _removed(raw, marks.as_py())
                n.append(len(raw))
                gone.append(sum(y - x for x, y in cut))
                spans.append(len(cut))
                sha.append(hashlib.sha256(_kept(raw, cut)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked(docs.select("doc_id", "text")).select("doc_id", "text", "marks").mapInArrow(run, OUT.format(kind=kind))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the remaining bytes as text; bytes of a cut character at a span's edge are left out."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, marks in zip(b.column(at), b.column(len(names)), strict=True):
                raw = text.as_py()
                if raw is not None and marks.as_py():
                    data = raw.encode()
                    raw = _kept(data, _removed(data, marks.as_py())).decode("utf-8", "ignore")
                texts.append(raw)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    plain = plain_names(names, ("text",))
    return marked(docs.toDF(*plain)).select(*plain, "marks").mapInArrow(run, ddl)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated bytes; n_chars follows; texts with nothing left go."""
    out = deduplicated(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where((F.length("text") > 0) | F.col("text").isNull()).select(*docs.columns)
