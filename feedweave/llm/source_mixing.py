"""Mixing sources to target weights (operator 2): pivotal dependent rounding through a distributed reduction tree.

Every source gets a word target; its documents get the expected number of copies target / source size. The whole part is
taken; the fractional parts are rounded in pairs. A pair transfers word mass at random, in expectation neither gains nor
loses, until one of the two is empty or full; the other goes on. Since the mass stays, a source's taken words differ from
its target by less than one document's words. Level one pairs within blocks of BLOCK documents of one source; each block
leaves one fractional document at most, and the next level pairs those, until every source has one block. DataFrame
functions only; hot sources are spread over many blocks.

Equal rows (same source, id, size and content hash) are one item with a multiplicity: they are counted before anything
is grouped, and their copies are shared out evenly. Defined cases: null text has size 0 and takes nothing; null sources
are a source of their own, last in order; null ids are kept; empty tables give empty results; ties are broken by content
hash; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweave.llm.common import WS_CHARS, documents, materialize, whole_text, words_of

BLOCK = 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
ACC = "struct<cur:struct<k:struct<_s:string,_id:bigint,_n:bigint,_h:bigint>,a:double,m:double>,out:array<struct<k:struct<_s:string,_id:bigint,_n:bigint,_h:bigint>,up:boolean>>>"
ITEM = "struct<k:struct<_s:string,_id:bigint,_n:bigint,_h:bigint>,a:double,m:double>"


def uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def ranked_sources(per: DataFrame) -> DataFrame:
    """per (a row per source) plus _i, the source's place from 0 by code point, null last: ranges of sources are sorted and
    each range's places start after the counts of those before."""
    order = F.col("_s").asc_nulls_last()
    ranged = per.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialize(ranged, "sources").withColumn("_range", F.shiftright("_id", 33))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))  # a row per task
    before = Window.partitionBy("_all").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "ranges")
    return ranged.join(starts, "_range").select(*per.columns, (F.col("start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("_i"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """_s, source_size, target: share of all words dealt by weight, capped at most times the source, the excess reshared.

    All uncapped sources get the same level times their weight. The level starts as if none were capped; sources that it
    fills are capped and the rest is dealt again, until none is above: each round is one sum over the sources.
    """
    per = sized.groupBy("_s").agg(F.sum("_n").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("_i").cast("int") % len(weights) + 1)
    per = ranked_sources(per).withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(most))
    per = materialize(per.select("_s", "source_size", "_w", "_cap"), "weights")
    whole = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("_cap") <= F.lit(level) * F.col("_w") if full >= 0 else F.lit(False)
        got = per.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w")))).first()
        if got[0] == full or not got[2]:
            break
        full, level = got[0], (float(share) * whole - (got[1] or 0.0)) / got[2]
    target = F.least(F.col("_cap"), F.lit(level) * F.col("_w")) if got[2] else F.col("_cap")
    return per.select("_s", "source_size", target.alias("target"))


def _step(level: int, seed: int):
    """One pairing: the carried item and the next one; what becomes whole goes to out."""

    def run(acc: Column, item: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        a, m, b, n = cur["a"], cur["m"], item["a"], item["m"]
        gain, loss = F.least(a - m, n), F.least(m, b - n)  # mass cur can get from item, or give to it
        u = uniform(cur["k"]["_id"], cur["k"]["_h"], item["k"]["_id"], item["k"]["_h"], F.lit(level), F.lit(seed))
        gains = u * (gain + loss) < loss
        cur_full, item_empty = gains & (a - m <= n), gains & (n <= a - m)
        cur_empty, item_full = ~gains & (m <= b - n), ~gains & (b - n <= m)
        moved = F.when(gains, gain).otherwise(-loss)
        next_ = (
            F.when((cur_full | cur_empty) & (item_full | item_empty), F.lit(None).cast(ITEM))
            .when(cur_full | cur_empty, F.struct(item["k"].alias("k"), b.alias("a"), (n - moved).alias("m")))
            .otherwise(F.struct(cur["k"].alias("k"), a.alias("a"), (m + moved).alias("m")))
        )
        none = F.lit(None).cast("struct<k:struct<_s:string,_id:bigint,_n:bigint,_h:bigint>,up:boolean>")
        done = F.array_compact(
            F.array(
                F.when(cur_full | cur_empty, F.struct(cur["k"].alias("k"), cur_full.alias("up"))).otherwise(none),
                F.when(item_full | item_empty, F.struct(item["k"].alias("k"), item_full.alias("up"))).otherwise(none),
            )
        )
        paired = F.struct(next_.alias("cur"), F.concat(out, done).alias("out"))
        return F.when(cur.isNull(), F.struct(item.alias("cur"), out.alias("out"))).otherwise(paired).cast(ACC)

    return run


def pivotal(items: DataFrame, largest: int, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """items (_k, _a words, _m fractional mass, strictly between 0 and _a), rounded: _k and up.

    largest: the number of items of the largest source, which fixes the number of levels.
    """
    leaves = max(1, math.ceil(largest / block))
    levels = 1 + max(0, math.ceil(math.log(leaves, block) - 1e-9))
    done, left = [], items
    for level in range(levels):
        # a block of one level is the union of blocks of the level below, so residuals meet along a tree
        leaf = F.pmod(F.xxhash64(F.lit(seed), "_k"), F.lit(leaves))
        key = F.floor(leaf / float(block**level)).cast("long")
        one = F.struct(F.col("_k").alias("k"), F.col("_a").alias("a"), F.col("_m").alias("m"))
        grouped = left.groupBy(F.col("_k._s").alias("_g"), key.alias("_b")).agg(F.collect_list(one).alias("_items"))
        start = F.struct(F.lit(None).cast(ITEM).alias("cur"), F.array().cast("array<struct<k:struct<_s:string,_id:bigint,_n:bigint,_h:bigint>,up:boolean>>").alias("out")).cast(ACC)
        ordered = F.array_sort("_items", lambda x, y: _compare(x, y))
        result = materialize(grouped.select(F.aggregate(ordered, start, _step(level, seed)).alias("r")), "pivotal")
        done.append(result.select(F.explode("r.out").alias("o")).select("o.k", "o.up"))
        left = result.where("r.cur is not null").select(F.col("r.cur.k").alias("_k"), F.col("r.cur.a").alias("_a"), F.col("r.cur.m").alias("_m"))
    last = uniform(F.col("_k._id"), F.col("_k._h"), F.lit("last"), F.lit(seed)) * F.col("_a") < F.col("_m")
    done.append(left.select(F.col("_k").alias("k"), last.alias("up")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("k").alias("_k"), "up")


def _compare(x: Column, y: Column) -> Column:
    """Long documents first. A long one is settled only after short ones have moved as much mass as it has room, so the one left may be long."""
    a, b = F.struct(-x["a"], x["k"]), F.struct(-y["a"], y["k"])
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def sized_documents(docs: DataFrame) -> DataFrame:
    """docs plus the key columns _s, _id (the id if it is a whole number, else its hash), _n (words) and _h (hash of the text)."""
    whole = docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    key = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    n = F.size(words_of(whole_text())).cast("long")
    return docs.withColumns({"_s": F.col("source"), "_id": key, "_n": n, "_h": F.xxhash64("text", *[c for c in docs.columns if c not in ("text", "doc_id", "source")])})


KEY = ("_s", "_id", "_n", "_h")


def copies(keyed: DataFrame, seed: int = 7) -> DataFrame:
    """One row per distinct key: KEY, rows (its multiplicity), source_size, target, total (copies for all its rows)."""
    items = materialize(keyed.groupBy(*KEY).agg(F.count("*").alias("rows")), "items")
    targets = materialize(source_targets(items.select("_s", (F.col("_n") * F.col("rows")).alias("_n"))), "targets")
    largest = items.groupBy("_s").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    # one row per source; Spark broadcasts it only under its size threshold
    both = items.alias("i").join(targets.alias("t"), F.col("i._s").eqNullSafe(F.col("t._s"))).select("i.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = both.withColumn("_want", F.when(F.col("_n") > 0, rate * F.col("rows")).otherwise(F.lit(0.0)))
    both = both.withColumn("_whole", F.floor(F.col("_want") + 1e-9)).withColumn("_part", F.greatest(F.col("_want") - F.col("_whole"), F.lit(0.0)))
    both = both.withColumn("_k", F.struct(*KEY))
    open_ = both.where(F.col("_part") > 1e-9).select("_k", F.col("_n").cast("double").alias("_a"), (F.col("_n") * F.col("_part")).alias("_m"))
    up = pivotal(open_, int(largest), seed).where("up").select(*[F.col(f"_k.{c}").alias(f"u{c}") for c in KEY])
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"u.u{c}")) for c in KEY]
    joined = both.alias("b").join(up.alias("u"), same, "left")
    total = (F.col("b._whole") + F.when(F.col("u.u_n").isNotNull(), 1).otherwise(0)).cast("long")
    return joined.select(*[F.col(f"b.{c}") for c in KEY], "b.rows", "b.source_size", "b.target", total.alias("total"))


def per_row(decided: DataFrame) -> DataFrame:
    """A row per document again: the copies of equal rows are shared out evenly."""
    each = F.floor(F.col("total") / F.col("rows"))
    rows = decided.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.withColumn("_copies", each + F.when(F.col("_i") <= F.col("total") - each * F.col("rows"), 1).otherwise(0))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    rows = per_row(copies(sized_documents(docs).select(*KEY)))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_n").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_n")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with every row as often as the mix takes it; names, types and repeats of docs are free."""
    names = docs.columns
    plain = [x if x in ("doc_id", "text", "source") else f"_in{i}" for i, x in enumerate(names)]
    keyed = sized_documents(docs.toDF(*plain))
    decided = copies(keyed.select(*KEY), seed).where("total > 0").select(*KEY, F.col("rows").alias("_rows"), F.col("total").alias("_total"))
    decided = materialize(decided, "copies")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in KEY]
    joined = keyed.alias("d").join(decided.alias("c"), same).select("d.*", "c._rows", "c._total")
    single = joined.where("_rows = 1").select(*plain, "_total")
    if not decided.where("_rows > 1").isEmpty():  # equal rows: one of them stands for all copies
        first = [F.first(c).alias(c) for c in plain]
        many = joined.where("_rows > 1").groupBy(*[F.col(c) for c in KEY]).agg(*first, F.first("_total").alias("_total"))
        single = single.unionByName(many.select(*plain, "_total"))
    again = single.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_total"))))
    return again.select(*plain).toDF(*names)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)
