"""Conversation prefix trie (operator 12): mergeable partial tries and a bottom-up rollup.

A node stands for a distinct sequence of first turns (role and text); the textless root has depth 0. Members of a node are
the conversations that start with it, its ends those that are it.

1. Turns become hashes and lengths and are sorted over ranges, so a hot conversation lies in many partitions. Runs of one
   conversation become pieces of at most PIECE turns; a piece's first place is a running sum over the pieces, which are
   thousands of times fewer than the turns.
2. A node's key is the XOR of a 128-bit hash of (place, turn) over its turns, so a piece needs of the pieces before it one
   number only. Each partition emits its partial trie, a table of nodes combined within the partition.
3. Partial tries merge in a tree: a round sums the members of equal keys over FAN neighbouring partitions, until one table
   is left. End lists are kept as blocks of at most BLOCK ids, merged in order of ids by ranges of (node, id); whatever
   reads a node's list reads it block by block, so no list is ever in memory whole.
4. The rollup goes up in steps that double: with the sums over descendants nearer than s and each node's ancestor s above
   it, adding the sums of all nodes to those ancestors gives the sums over descendants nearer than 2 s. A trie of depth d
   takes log2(d) + 1 rounds, however long its longest conversation is.

Defined cases: null role or text is empty; null turns come first; equal turns follow role, then the text's first HEAD
characters, then its hash; repeated rows are repeated turns; a null conv_id is a conversation of its own that counts as a
member but is named neither as the smallest one nor in lists; an empty table gives an empty result; texts are hashed and
counted whole; extra columns are not read. Sequences are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweave.llm.common import crc32_sql, discard, materialize

PIECE = 4096
BLOCK = 512
FAN = 256
HEAD = 64
#: Nodes that a partition combines at a time.
ROWS = 1 << 18
PIECE_DDL = "conv_id long, seq long, n int, a array<long>, b array<long>, chars array<int>"
NODE_DDL = "ka long, kb long, pa long, pb long, depth long, chars int, members long, least long, part int"
KEY = ["ka", "kb"]


def pieces(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, start, n, a, b, chars: consecutive turns of a conversation as two hashes and a length each, written as a table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.left(text, F.lit(HEAD)).alias("head"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), text, role).alias("b"),
        F.char_length(text).alias("chars"),
    )
    order = ["conv_id", "turn", "role", "head", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 33
        for b in batches:
            ends = pc.run_end_encode(b.column(0)).run_ends.to_numpy()
            cuts = np.unique(np.concatenate([ends, np.arange(0, b.num_rows, piece)]))
            cuts = cuts if len(cuts) and cuts[0] == 0 else np.append(0, cuts)
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), b.column(k)) for k in (1, 2, 3)]
            n = len(cuts) - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cuts[:-1])), pa.array(np.arange(seq, seq + n)), pa.array(np.diff(cuts), pa.int32()), *lists], names=["conv_id", "seq", "n", "a", "b", "chars"])
            seq += n

    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "chars")
    cut = materialize(rows.mapInArrow(run, PIECE_DDL), "pieces")
    before = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select("conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.col("n").cast("long").alias("n"), "a", "b", "chars")


def grafted(cut: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Pieces (conv_id, start, a, b, chars) and ids of conversations whose first turns are another's.

    Conversation c gets the first h turns of conversation c - c % every, h = crc32 of c in decimal % most, then its own
    turns after its first h. An absent conversation gives no turns, a short one all it has.
    """
    heads = cut.where((F.col("conv_id") % every == 0) & (F.col("start") < most - 1))
    first = [F.slice(c, F.lit(1), F.lit(most - 1) - F.col("start").cast("int")).alias(c) for c in ("a", "b", "chars")]
    heads = heads.groupBy(F.col("conv_id").alias("anchor")).agg(F.array_sort(F.collect_list(F.struct("start", *first))).alias("_h"))
    heads = heads.select("anchor", *[F.flatten(F.col("_h")[c]).alias(c) for c in ("a", "b", "chars")])
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % most, F.lit(0)).cast("int")
    convs = cut.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("anchor"))
    none = {"a": "array<long>", "b": "array<long>", "chars": "array<int>"}
    taken = [F.coalesce(F.slice(c, F.lit(1), F.col("h")), F.array().cast(none[c])).alias(c) for c in none]
    convs = materialize(convs.join(heads, "anchor", "left").select("conv_id", "h", *taken), "grafts")
    grafts = convs.where(F.size("a") > 0).select("conv_id", F.lit(0).cast("long").alias("start"), "a", "b", "chars")
    own = cut.alias("p").join(convs.select("conv_id", "h", F.size("a").alias("k")).alias("c"), F.col("p.conv_id").eqNullSafe(F.col("c.conv_id")))
    drop = F.greatest(F.col("h") - F.col("start"), F.lit(0)).cast("int")
    own = own.where(F.col("start") + F.col("n") > F.col("h"))
    rest = [F.slice(c, drop + 1, F.col("n").cast("int")).alias(c) for c in ("a", "b", "chars")]
    own = own.select("p.conv_id", (F.col("start") + drop - F.col("h") + F.col("k")).alias("start"), *rest)
    return grafts.unionByName(own), convs.select("conv_id")


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def placed(cut: DataFrame) -> DataFrame:
    """Pieces with the keys of the nodes before them: conv_id, start, xa, xb, chars, base_a, base_b, last."""
    at = [F.transform(c, lambda v, i: F.xxhash64(v, F.col("start") + i)).alias(f"x{c}") for c in ("a", "b")]
    hashed = cut.select("conv_id", "start", *at, "chars")
    order = Window.partitionBy("conv_id").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    hashed = materialize(hashed.withColumns({"_a": _xor(F.col("xa")), "_b": _xor(F.col("xb"))}), "hashed")
    base = [F.coalesce(F.bit_xor(f"_{c}").over(before), F.lit(0)).cast("long").alias(f"base_{c}") for c in ("a", "b")]
    return hashed.select("conv_id", "start", "xa", "xb", "chars", *base, F.lead("start").over(order).isNull().alias("last"), "_a", "_b")


def partial_tries(rows: DataFrame) -> DataFrame:
    """Nodes on the ways of a partition's pieces, combined within the partition."""

    def combined(parts: list[pa.Table], part: int) -> pa.RecordBatch:
        t = pa.concat_tables(parts).group_by(["ka", "kb"], use_threads=False)
        t = t.aggregate([("pa", "min"), ("pb", "min"), ("depth", "min"), ("chars", "min"), ([], "count_all"), ("conv_id", "min")])
        cols = [t.column(c).combine_chunks() for c in ("ka", "kb", "pa_min", "pb_min", "depth_min", "chars_min", "count_all", "conv_id_min")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(t), part), pa.int32())], names=["ka", "kb", "pa", "pb", "depth", "chars", "members", "least", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0
        for b in batches:
            conv, start, xa, xb, chars, base_a, base_b = b.columns
            ends = np.cumsum(pc.list_value_length(xa).to_numpy(zero_copy_only=False))
            count = np.diff(ends, prepend=0)
            first = ends - count
            owner = np.repeat(np.arange(b.num_rows), count)
            cols = {"conv_id": conv.take(pa.array(owner)), "depth": pa.array(start.to_numpy()[owner] + np.arange(len(owner)) - first[owner] + 1), "chars": chars.flatten()}
            for k, p, x, base in (("ka", "pa", xa, base_a), ("kb", "pb", xb, base_b)):
                # XORs up to each turn of a piece: those over the whole batch, less what stood before the piece
                run_ = np.append(np.int64(0), np.bitwise_xor.accumulate(x.flatten().to_numpy()))
                lead = base.to_numpy() ^ run_[first]
                cols[k] = pa.array(run_[1:] ^ lead[owner])
                cols[p] = pa.array(run_[:-1] ^ lead[owner])
            held.append(pa.table(cols))
            size += len(owner)
            if size >= ROWS:
                yield combined(held, part)
                held, size = [], 0
        if size:
            yield combined(held, part)

    return rows.select("conv_id", "start", "xa", "xb", "chars", "base_a", "base_b").mapInArrow(run, NODE_DDL)


def merged(partial: DataFrame, fan: int = FAN) -> DataFrame:
    """One row a node: partial tries of fan neighbouring partitions become one, round by round."""
    table = materialize(partial, "partial")
    width = 1 + (table.agg(F.max("part")).first()[0] or 0)
    while True:
        width = -(-width // fan)
        group = F.floor(F.col("part") / fan).cast("int")
        table = table.groupBy(*KEY, group.alias("part")).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.sum("members").alias("members"), F.min("least").alias("least"))
        table = materialize(table, "merged")
        if width <= 1:
            return table.drop("part")


def end_blocks(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """ka, kb, seq, ids: each node's ends (rows ka, kb, conv_id), ascending, as blocks in order of seq."""
    order = [*KEY, "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 33
        for b in batches:
            a, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.flatnonzero((a[1:] != a[:-1]) | (k[1:] != k[:-1])) + 1
            cuts = np.unique(np.concatenate([new, np.arange(0, b.num_rows, block), [0, b.num_rows]])).astype(np.int32)
            at = pa.array(cuts[:-1])
            n = len(cuts) - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.arange(seq, seq + n)), pa.ListArray.from_arrays(pa.array(cuts), b.column(2))], names=["ka", "kb", "seq", "ids"])
            seq += n

    rows = ends.where("conv_id is not null").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "ka long, kb long, seq long, ids array<long>")


def end_digests(blocks: DataFrame) -> DataFrame:
    """ka, kb, ends_sha256 of the comma-joined decimal ids; blocks stream through, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            done = []
            for a, k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                body = ",".join(map(str, ids.values.to_pylist())).encode()
                if node == (a, k):
                    digest.update(b"," + body)
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (a, k), hashlib.sha256(body)
            yield _rows(done)
        if node is not None:
            yield _rows([(*node, digest.hexdigest())])

    def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["ka", "kb", "ends_sha256"])

    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "seq").select(*KEY, "ids").mapInArrow(run, "ka long, kb long, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """ka, kb, n_leaves, saved: sums over each node's subtree."""
    table = nodes.select(*KEY, "depth", F.col("pa").alias("ua"), F.col("pb").alias("ub"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("members") - 1) * F.col("chars")).alias("saved"))
    deepest, step = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        lower = table.where(F.col("depth") >= step)
        given = lower.groupBy(F.col("ua").alias("ka"), F.col("ub").alias("kb")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved").alias("_s"))
        table_ = table.join(given, KEY, "left").select(*KEY, "depth", "ua", "ub", (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"))
        if 2 * step <= deepest:
            # only nodes that have an ancestor 2 * step above look it up
            up = table.where(F.col("depth") >= step).select(F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("ua").alias("va"), F.col("ub").alias("vb"))
            far = F.col("depth") >= 2 * step
            high = table_.where(far).join(up, ["ua", "ub"]).select(*KEY, "depth", F.col("va").alias("ua"), F.col("vb").alias("ub"), "n_leaves", "saved")
            table_ = table_.where(~far).unionByName(high)
        before, table = table, materialize(table_, "rollup")
        if step > 1:
            discard(before)
        step *= 2
    return table.select(*KEY, "n_leaves", "saved")


def prefix_trie(cut: DataFrame, convs: DataFrame, fan: int = FAN, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Nodes (ka, kb, pa, pb, depth, chars, members, least, n_children, parent_least, n_leaves, saved) and end blocks (ka, kb, seq, ids).

    cut: pieces conv_id, start, a, b, chars; convs: the id of every conversation, also of those without turns.
    """
    rows = materialize(placed(cut), "placed")
    zero = F.lit(0).cast("long")
    root = convs.groupBy().agg(F.count("*").alias("members"), F.min("conv_id").alias("least")).where("members > 0")
    none = F.lit(None).cast("long")
    root = root.select(zero.alias("ka"), zero.alias("kb"), none.alias("pa"), none.alias("pb"), zero.alias("depth"), F.lit(0).alias("chars"), "members", "least")
    below = merged(partial_tries(rows), fan)
    children = below.groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    nodes = root.unionByName(below).join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialize(nodes, "nodes")
    parents = nodes.where("n_children > 0").select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("least").alias("parent_least"))
    full = nodes.join(parents, ["pa", "pb"], "left").join(rolled_up(nodes), KEY)
    finals = rows.where("last").select(F.col("base_a").bitwiseXOR(F.col("_a")).alias("ka"), F.col("base_b").bitwiseXOR(F.col("_b")).alias("kb"), "conv_id")
    bare = convs.join(rows.select("conv_id").distinct(), "conv_id", "left_anti").where("conv_id is not null").select(zero.alias("ka"), zero.alias("kb"), "conv_id")
    return full, end_blocks(finals.unionByName(bare), block)


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of conversations as they are, with role and text of their last turn (null at the root)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = [F.col("turn").cast("long"), role, F.left(text, F.lit(HEAD)), F.xxhash64(F.lit(1), role, text), F.xxhash64(F.lit(2), text, role)]
    # members share the turn, so the smallest member's is read; only members that name a node are numbered
    named = nodes.select(F.col("least").alias("conv_id")).distinct()
    turns = conversations.withColumn("conv_id", F.col("conv_id").cast("long")).join(named, "conv_id", "left_semi")
    turns = turns.select(F.col("conv_id").alias("least"), F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long").alias("depth"), role.alias("role"), text.alias("text"))
    return nodes.join(turns, ["least", "depth"], "left")


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and end blocks of conversations as they are."""
    cut = pieces(conversations)
    return prefix_trie(cut, cut.select("conv_id").distinct())


def digests(conversations: DataFrame, piece: int = PIECE, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """The query's rows: conversations with grafted first turns, as a trie, its end lists as hashes."""
    nodes, blocks = prefix_trie(*grafted(pieces(conversations, piece), 100, 6), fan, block)
    out = nodes.join(end_digests(blocks), KEY, "left")
    return out.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.col("parent_least").alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k
    FROM conversations),
convs AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 6 AS h, conv_id - conv_id % 100 AS anchor FROM (SELECT DISTINCT conv_id FROM turns)),
grafted AS (
    SELECT c.conv_id, 0 AS own, k, role, text FROM convs c JOIN turns t ON t.conv_id = c.anchor AND k < h
    UNION ALL SELECT c.conv_id, 1, k, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND k >= h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS d, role, text FROM grafted),
keyed AS (
    SELECT conv_id, d, length(text) AS chars, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key
    FROM numbered),
rooted AS (SELECT * FROM keyed UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ways AS MATERIALIZED (
    SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS up, lead(d) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS last FROM rooted),
nodes AS (
    SELECT key, min(conv_id) AS least, min(d) AS depth, min(up) AS up, count(*) AS members, min(chars) AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
    FROM ways GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
sized AS MATERIALIZED (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
sums AS (
    SELECT w.key, sum((s.n_children = 0)::INT)::BIGINT AS n_leaves, sum((s.members - 1) * s.chars)::BIGINT AS saved
    FROM sized s JOIN ways w ON w.conv_id = s.least AND w.d <= s.depth GROUP BY w.key)
SELECT s.least AS conv_id, s.depth, p.least AS parent_conv_id, s.members AS n_convs, s.n_children, n_leaves, saved AS saved_tokens, s.ends_sha256
FROM sized s JOIN sums USING (key) LEFT JOIN sized p ON p.key = s.up
"""
