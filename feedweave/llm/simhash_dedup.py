"""SimHash near-dedup (operator 7): generalised pigeonhole search over 64-bit fingerprints.

1. A fingerprint per document: 64-bit hashes of word shingles vote per bit.
2. Equal fingerprints are grouped first; the search runs over distinct fingerprints.
3. Plan, on a bounded sample of SAMPLE distinct fingerprints (those of the smallest hash): bits are grouped into m parts so
   that correlated bits share a part; thresholds t_i >= -1 with sum(t_i) = distance - m + 1 are allocated by dynamic
   programming on estimated rows and candidates. By the generalised pigeonhole principle every pair within the distance
   differs in at most t_i bits of some part i, whatever the plan, so results do not depend on the sample.
4. Probe: a part with t = -1 emits nothing, t = 0 its key, t = 1 or 2 its key and all keys one bit away (two keys two bits
   apart meet at the key between them). Fingerprints that share a key are candidates.
5. Verify: within a key all distances are computed in blocks, and a spanning forest of the links comes out, at most one
   row per fingerprint, never all pairs. Keys are counted first; one with more than BUCKET fingerprints is split by a shuffle,
   by the same principle on the remaining bits, until it fits, so no task gathers more than BUCKET of them.
6. Components by alternating large-star and small-star rounds, each cut by a written table.

The pipeline's stage needs all pairs of a Jaccard similarity of 4/5 or more, some ten bits of 64 apart, where pigeonhole keys
meet a large share of all pairs. There the search above proposes close pairs; the others are found by the pigeonhole
principle on the shingle sets themselves (prefixes), and every pair is verified on the sets.

Defined cases: null text counts as empty; texts without a word have fingerprint zero, linked like any other; null ids
are rows that never name a component unless nothing else is in it; repeated rows share one component; an empty table
gives an empty result; only doc_id and text are read. The stage keeps one row of each component, whatever its ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import discard, documents, materialize, plain_names

SEED = 42
DISTANCE = 4
SAMPLE = 2048
BUCKET = 4096
#: Cost of a candidate distance, in emitted rows.
PAIR_COST = 0.02
#: Counters by which the stage orders shingles.
SKETCH_BITS = 21
SKETCH_SHIFT = np.uint64(64 - SKETCH_BITS)
SKETCH_SLICES = 16
#: Hubs that a set is compared with before the search of all pairs that are left.
STARS = 4
SALTED = 4
#: Sets of na and nb shingles whose prefixes share c can have the overlap that a similarity of 4/5 takes: one set's prefix
#: ends first, and only what follows there can add to c.
ENOUGH = "9 * (c + greatest(na - na div 5 - 1, nb - nb div 5 - 1)) >= 4 * (na + nb)"
#: Neither set is over 5/4 of the other.
ALIKE = "5 * least(na, nb) >= 4 * greatest(na, nb)"
#: The first token that two such sets share, at places pa and pb, has enough behind it in both: a pair passes there.
IN_TIME = "9 * least(na - pa, nb - pb) >= 4 * (na + nb)"


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles, repeats too (fewer words than width: of the whole sequence; no word: none)."""
    upper = (text or "").encode()
    words = upper.lower().split()  # bytes: A-Z only, and splits at 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    at = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], at[: n - width])).tolist()
    ends = (at[width - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, width: int) -> int:
    """A bit is 1 if set in over half of the hashes of the word shingles (fewer words than width: of the whole sequence)."""
    return majority(shingles(text, width))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(x.as_py(), width) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(fps: np.ndarray, m: int, among: list[int]) -> list[list[int]]:
    """m parts of near-equal width; each grows from the free bit of the strongest correlations by the bit closest to it."""
    x = _bits(fps).astype(np.float64)
    with np.errstate(all="ignore"):
        c = np.nan_to_num(np.abs(np.corrcoef(x, rowvar=False))) if len(fps) > 1 else np.zeros((64, 64))
    np.fill_diagonal(c, 0)
    free, parts = list(among), []
    for k in range(m):
        width = len(free) // (m - k)
        part = [max(free, key=lambda b: (c[b, free].sum(), -b))]
        while len(part) < width:
            rest = [b for b in free if b not in part]
            part.append(max(rest, key=lambda b: (c[b, part].sum(), -b)))
        free = [b for b in free if b not in part]
        parts.append(sorted(part))
    return parts


def _mask(part: list[int]) -> int:
    return sum(1 << b for b in part)


def estimate(fps: np.ndarray, part: list[int], t: int) -> float:
    """Share of pairs that differ in at most t bits of the part: seen in the sample, and not under what random bits give."""
    from math import comb

    even = sum(comb(len(part), k) for k in range(t + 1)) / 2.0 ** len(part)
    got = fps & np.uint64(_mask(part))
    near = sum(int((np.bitwise_count(got[k + 1 :] ^ got[k]) <= t).sum()) for k in range(len(got) - 1))
    pairs = len(got) * (len(got) - 1) / 2
    return max(even, near / pairs if pairs else 0.0)


def plan(fps: np.ndarray, n: int, distance: int, among: list[int] | None = None, parts_from: int = 1) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, of least estimated cost over all numbers of parts."""
    among = list(range(64)) if among is None else among
    best = None
    for m in range(parts_from, min(distance + 1, len(among)) + 1):
        parts = group_bits(fps, m, among)
        cost = []
        for p in parts:
            row = {-1: 0.0}
            for t in (0, 1, 2):
                rows = 1 if t == 0 else len(p) + 1
                row[t] = n * rows + PAIR_COST * estimate(fps, p, max(t, 2 * (t > 0))) * n * n / 2 * (1 if t == 0 else 2)
            cost.append(row)
        # dynamic programming over parts: least cost for each sum of thresholds
        table = {0: (0.0, ())}
        for row in cost:
            step: dict[int, tuple[float, tuple]] = {}
            for s, (c, ts) in table.items():
                for t, x in row.items():
                    if s + t not in step or c + x < step[s + t][0]:
                        step[s + t] = (c + x, (*ts, t))
            table = step
        need = distance - m + 1
        reach = [v for s, v in table.items() if s >= need]
        if reach and (best is None or min(reach)[0] < best[0]):
            best = (min(reach)[0], list(zip(parts, min(reach)[1], strict=True)))
    if best is None:
        raise ValueError("no plan: the distance is too large for keys of one changed bit")
    return best[1]


def keys(fps: np.ndarray, plan_: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, key, fp) of all fingerprints."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, (part, t) in enumerate(plan_):
        if t < 0:
            continue
        own = fps & np.uint64(_mask(part))
        flips = [0] if t == 0 else [0, *(1 << b for b in part)]
        for f in flips:
            out.append((np.full(len(fps), i, np.int32), own ^ np.uint64(f), fps))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int32), fps[:0], fps[:0])


def forest(fps: np.ndarray, distance: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least member, member) of the components of links within the distance among distinct fps."""
    n = len(fps)
    label = np.arange(n)
    for a in range(0, n, block):
        for b in range(a, n, block):
            near = np.bitwise_count(fps[a : a + block, None] ^ fps[None, b : b + block]) <= distance
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            keep = i < j
            i, j = i[keep], j[keep]
            while len(i):  # least labels travel along links and jump until no link joins two labels
                low = np.minimum(label[i], label[j])
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
                keep = label[i] != label[j]
                i, j = i[keep], j[keep]
    member = np.nonzero(label != np.arange(n))[0]
    return fps[label[member]], fps[member]


def _keyed(flips: Column, own: Column, part: int, mask: int) -> Column:
    return F.transform(flips, lambda f: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(f).alias("key"), F.lit(mask).alias("used")))


def _probe(distinct: DataFrame, plan_: list[tuple[list[int], int]]) -> DataFrame:
    """g (name of part and key), used (the part's bits), fp rows as column expressions."""
    rows = []
    for i, (part, t) in enumerate(plan_):
        if t < 0:
            continue
        mask = int(np.uint64(_mask(part)).view(np.int64))
        flips = F.array(*[F.lit(int(np.uint64(f).view(np.int64))) for f in [0, *((1 << b for b in part) if t else ())]])
        rows.append(_keyed(flips, F.col("fp").bitwiseAND(F.lit(mask)), i, mask))
    each = distinct.select("fp", F.explode(F.concat(*rows)).alias("k"))
    return each.select(F.xxhash64("k.part", "k.key").alias("g"), "k.used", "fp")


def split_keys(rows: DataFrame, distance: int) -> DataFrame:
    """g, used, fp of large keys, dealt to keys of distance + 1 parts of the bits not used yet.

    Of two fingerprints within the distance one part is equal, so they still meet. Both have the same used bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, used, fp = (b.column(i).to_numpy() for i in range(3))
            for mask in np.unique(used):
                own = used == mask
                free = [k for k in range(64) if not int(np.int64(mask).view(np.uint64)) >> k & 1]
                parts = [free[k :: distance + 1] for k in range(min(distance + 1, len(free)))] or [[]]
                for part in parts:
                    bits = np.uint64(_mask(part)).view(np.int64)
                    name = np.frombuffer(np.stack([g[own], np.full(own.sum(), bits), fp[own] & bits], 1).tobytes(), "V24")
                    key = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in name), np.uint64, len(name)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), mask | bits)), pa.array(fp[own])], names=["g", "used", "fp"])

    return rows.select("g", "used", "fp").mapInArrow(run, "g long, used long, fp long")


def _forests(distance: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            values = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.diff(np.concatenate(([0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False)))))
            start = np.concatenate(([0], np.cumsum(at)))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            # small buckets together: every offset within a bucket is one vector operation
            small = at <= 16
            for k in range(1, 16):
                for off in range(k):
                    rows = np.nonzero(small & (at > k))[0]
                    x, y = values[start[rows] + off], values[start[rows] + k]
                    near = np.bitwise_count(x ^ y) <= distance
                    if near.any():
                        out.append((x[near], y[near]))
            for r in np.nonzero(~small)[0]:
                out.append(forest(np.unique(values[start[r] : start[r + 1]]), distance))
            if out:
                a, c = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["a", "b"])

    return verify


def edges(distinct: DataFrame, n: int, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """a, b: a spanning set of links between distinct fingerprints (column fp)."""
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    fps = np.array([r["fp"] for r in sample], np.int64).view(np.uint64)
    rows, out = _probe(distinct, plan(fps, n, distance)), None
    while True:
        counts = materialize(rows.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > bucket).select("g"), "large")
        hot = not counts.isEmpty()
        few = rows.join(counts, "g", "left_anti") if hot else rows
        found = few.groupBy("g").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps").mapInArrow(_forests(distance), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not hot:
            return out.distinct()
        # distinct fingerprints run out of bits to share, so the rounds end: with 12 bits left a key has 4,096 at most
        rows = materialize(split_keys(rows.join(counts, "g"), distance), "split")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for every node of a link its component's least node, by large-star and small-star rounds.

    Aggregates are written before rows meet them in a join, as adaptive execution splits a hub's rows only then.
    """
    links = materialize(links, "links")
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), "low")
        # done when every node with a lesser neighbour has no other: all hang on one root, and no root on another
        if low.where("m < a and c > 1").isEmpty():
            discard(low)
            break
        large = both.where("b > a").join(low.select("a", F.least("a", "m").alias("m")), "a").select(F.col("m").alias("a"), "b")
        # small-star: each node points its smaller neighbours and itself to the least of them
        down = materialize(large.where("a <> b").distinct().select(F.col("b").alias("n"), F.col("a").alias("s")), "star")
        least = materialize(down.groupBy("n").agg(F.min("s").alias("m")), "least")
        small = down.join(least, "n").select(F.col("m").alias("a"), F.explode(F.array("n", "s")).alias("b")).where("a <> b").distinct()
        nxt = materialize(small, "links")
        discard(links, low, down, least)
        links = nxt
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root"))


def classes(docs: DataFrame, width: int, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id (least doc_id that links reach)."""
    marked = materialize(fingerprints(docs, width), "fingerprints")
    per = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(edges(per.select("fp"), per.count(), distance))
    linked = per.alias("p").join(roots.alias("r"), F.col("p.fp") == F.col("r.node"), "left").select("p.fp", "p.least", F.coalesce("r.root", "p.fp").alias("root"))
    linked = materialize(linked, "linked")
    low = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "low")
    names = materialize(linked.join(low, "root").select("fp", "component_id"), "names")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir), width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def scanned(rows: DataFrame, width: int) -> DataFrame:
    """row, fp, s1, s2 (name of the set of shingles); and per task its part of the sketch (slice, sketch; row is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            fp, name = np.empty(b.num_rows, np.uint64), bytearray()
            for k, text in enumerate(b.column(1)):
                hashes = shingles(text.as_py(), width)
                own = np.unique(hashes)
                np.add.at(counts, own >> SKETCH_SHIFT, 1)
                fp[k] = majority(hashes)
                name += xxhash.xxh3_128_digest(own.tobytes())
            names = np.frombuffer(bytes(name), "<i8").reshape(-1, 2)
            none = [pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), pa.array(names[:, 0]), pa.array(names[:, 1]), *none], names=["row", "fp", "s1", "s2", "slice", "sketch"])
        if counts.any():
            parts = [zstandard.compress(x.tobytes(), 1) for x in np.split(counts, SKETCH_SLICES)]
            none = [pa.nulls(SKETCH_SLICES, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["row", "fp", "s1", "s2", "slice", "sketch"])

    return rows.select("row", "text").mapInArrow(run, "row long, fp long, s1 long, s2 long, slice int, sketch binary")


def sketch(scan: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each group of hashes; only an order is taken from it."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in pdf["sketch"])
        return pd.DataFrame({"slice": [key[0]], "sketch": [zstandard.compress(total.tobytes(), 1)]})

    got = scan.where("sketch is not null").select("slice", "sketch").groupBy("slice").applyInPandas(add, "slice int, sketch binary").collect()
    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.int64)
    for r in got:
        out[r["slice"]] = np.frombuffer(zstandard.decompress(bytes(r["sketch"])), np.int64)
    return out.reshape(-1)


def prefixes(rows: DataFrame, counts: np.ndarray, width: int) -> DataFrame:
    """token, node, n, p: of each set of n shingles the n // 5 + 1 rarest by counts (any fixed order is right), p their places.

    Sets of similarity 4/5 or more share a token: of two sets in one order, the overlap of 4/5 of either cannot lie
    beyond both prefixes.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, lens, sizes = [], [], []
            for text in b.column(1):
                own = np.unique(shingles(text.as_py(), width))
                first = own[np.argsort(shared.value[own >> SKETCH_SHIFT], kind="stable")[: len(own) // 5 + 1]]
                tokens.append(first)
                lens.append(len(first))
                sizes.append(len(own))
            token = np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, np.int64)
            n = np.array(lens, np.int64)
            place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            node = np.repeat(b.column(0).to_numpy(), lens)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int32), lens)), pa.array(place.astype(np.int32))], names=["token", "node", "n", "p"])

    return rows.select("row", "text").mapInArrow(run, "token long, node long, n int, p int")


def verified(pairs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The pairs a, b of rows whose sets of shingles have a Jaccard similarity of 4/5 or more, exactly."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(x.as_py(), width)).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "own"])

    # written, so that the planner sees their size: few ids are broadcast and no text is shuffled
    ids = materialize(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "ids")
    sets = materialize(rows.join(ids, "row", "left_semi").select("row", "text").mapInArrow(run, "row long, own array<long>"), "sets")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("own").alias("y")), "b")
    both = both.where(5 * F.least(F.size("x"), F.size("y")) >= 4 * F.greatest(F.size("x"), F.size("y")))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    out = materialize(both.where(9 * common >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "verified")
    discard(pairs, ids, sets)
    return out


def similar(rows: DataFrame, width: int) -> DataFrame:
    """row, root: components of the rows (row, text) by links of similarity 4/5 or more; no two components have a link.

    Equal sets are one node. Links within groups come first, from pairs of fingerprints within DISTANCE bits and from a few
    hubs that share a node's tokens; then all pairs that share tokens in time and are not yet in one component are compared,
    so that most of a large group of near copies costs a few comparisons each.
    """
    scan = materialize(scanned(rows, width), "scanned")
    counts = sketch(scan)
    names = scan.where("sketch is null").select("row", "fp", "s1", "s2")
    sets = materialize(names.groupBy("s1", "s2").agg(F.min(F.struct("row", "fp")).alias("first")).select("s1", "s2", F.col("first.row").alias("node"), F.col("first.fp").alias("fp")), "sets")
    # fingerprints of one node each that searches on for all of the same fingerprint
    per = materialize(sets.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    near = edges(per.select("fp"), per.count())
    ends = near.join(per.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(per.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = sets.join(per, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))

    found = materialize(prefixes(rows, counts, width), "prefixes")
    again = materialize(found.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "tokens")
    shared = materialize(found.join(again, "token").join(sets.select("node"), "node", "left_semi").select("token", "node", "n", "p"), "shared")
    discard(found, again)
    links = verified(ends.unionByName(equal).unionByName(stars(shared)), rows, width)
    roots = components(links)
    placed = materialize(shared.join(roots, "node", "left").select("token", "node", "n", "p", F.coalesce("root", "node").alias("root")), "placed")
    kinds = placed.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots"))
    kinds = materialize(kinds.where("roots > 1").select("token", F.col("most.root").alias("main")), "kinds")
    open_ = materialize(placed.join(kinds, "token"), "open")
    discard(placed, kinds)
    x = open_.where("root <> main").select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("root").alias("ra"))
    y = open_.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("root").alias("rb"), "main")
    across = x.join(y, "token").where(f"ra <> rb and (rb = main or a < b) and {ALIKE} and {IN_TIME}")
    across = materialize(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")
    links = links.unionByName(verified(promising(across, shared), rows, width))
    discard(open_, shared, across)
    roots = components(links)
    by_set = sets.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("root"))
    return names.join(by_set, ["s1", "s2"]).select("row", "root")


def stars(shared: DataFrame) -> DataFrame:
    """Pairs a, b that share tokens (shared: token, node, n, p): each node with at most STARS hubs.

    Hubs of a token are the set in which it is rarest of all, a document near the middle of its group, the smallest one,
    and some that salted hashes pick.
    """
    first = {"u": F.struct("p", "node", "n"), "v": F.struct("n", "node")}
    first |= {f"w{k}": F.struct(F.xxhash64("node", F.lit(k)).alias("k"), "node", "n") for k in range(SALTED)}
    hubs = shared.groupBy("token").agg(*[F.min(x).alias(k) for k, x in first.items()])
    kinds = [F.struct(F.col(f"{x}.node").alias("b"), F.col(f"{x}.n").alias("nb")) for x in first]
    hubs = materialize(hubs.select("token", F.explode(F.array_distinct(F.array(*kinds))).alias("hub")).select("token", "hub.*"), "hubs")
    met = shared.join(hubs, "token").where("node <> b").groupBy("node", "b").agg(F.count("*").alias("c"), F.first("n").alias("na"), F.first("nb").alias("nb"))
    # of the hubs of a document's own prefix
    best = met.where(f"{ALIKE} and {ENOUGH}").groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), asc=False), 1, STARS).alias("best"))
    return best.select(F.col("node").alias("a"), F.explode("best.b").alias("b"))


def promising(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The pairs a, b whose prefixes share so many tokens that a similarity of 4/5 is possible."""
    ids = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    # one list per document, of its own prefix
    lists = materialize(shared.join(ids, "node").groupBy("node").agg(F.first("n").alias("n"), F.collect_list("token").alias("own")), "lists")
    both = pairs.join(lists.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("own").alias("x")), "a").join(lists.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("own").alias("y")), "b")
    return both.withColumn("c", F.size(F.array_intersect("x", "y"))).where(ENOUGH).select("a", "b")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row stays of each component of five-word shingle sets, of least id (null ids last)."""
    names = docs.columns
    plain = plain_names(names, ("doc_id", "text"))
    rows = materialize(docs.toDF(*plain).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = rows.select("doc_id", "row").join(similar(rows.select("row", "text"), width=5), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    keep = materialize(found.groupBy("root").agg(first).select(F.col("first.row").alias("row")), "keep")
    return rows.join(keep, "row", "left_semi").select(*plain).toDF(*names)
