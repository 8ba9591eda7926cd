"""Captured JSON responses of pages within a byte budget.

A page's captures are taken in order; one that is too large, or that would pass the page's total, is left out and later
ones may still fit. What fits depends on all before it, so it is a fold and no running sum: sorted sizes are folded in
pieces of PIECE captures, and a piece starts with the total the one before ended with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.sources.shared import written

#: Bytes of one capture and of all captures of a page.
MAX_BODY_BYTES = 500_000
MAX_TOTAL_BYTES = 2_000_000
PIECE = 4096


def within_budget(rows: DataFrame, by: str, order: list[str], body: str = "body", most_each: int = MAX_BODY_BYTES, most_total: int = MAX_TOTAL_BYTES, piece: int = PIECE) -> DataFrame:
    """The rows of each group that a budget in bytes admits, in order (ties by body). Null and empty bodies go; null groups are one."""
    names = rows.columns
    plain = rows.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {n: f"_c{i}" for i, n in enumerate(names)}
    group, text = F.col(at[by]), F.col(at[body])
    size = F.octet_length(text).cast("long")
    fit = plain.where((size > 0) & (size <= most_each)).withColumns({"_g": group, "_size": size, "_k": F.row_number().over(Window.partitionBy(group).orderBy(*[at[o] for o in order], text)) - 1})
    fit = written(fit, "captures")
    pieces = fit.groupBy("_g", F.floor(F.col("_k") / piece).alias("_piece")).agg(F.array_sort(F.collect_list(F.struct("_k", "_size"))).alias("_rows"), F.sum("_size").alias("_sum"))
    pieces = written(pieces, "pieces")
    last = pieces.agg(F.max("_piece")).first()[0]
    none = F.struct(F.col("_total").alias("total"), F.array().cast("array<int>").alias("kept"))

    def step(acc, r):
        more = acc["total"] + r["_size"]
        return F.when(more <= most_total, F.struct(more.alias("total"), F.concat(acc["kept"], F.array(r["_k"])).alias("kept"))).otherwise(acc)

    state, kept = None, []
    for k in range((last if last is not None else -1) + 1):
        now = pieces.where(F.col("_piece") == k)
        start = now.withColumn("_total", F.lit(0).cast("long")) if state is None else now.alias("n").join(state.alias("s"), F.col("n._g").eqNullSafe(F.col("s._g"))).select("n.*", "s._total")
        whole = F.col("_total") + F.col("_sum") <= most_total  # nothing to leave out
        folded = F.when(whole, F.struct((F.col("_total") + F.col("_sum")).alias("total"), F.transform("_rows", lambda r: r["_k"]).alias("kept"))).otherwise(F.aggregate("_rows", none, step))
        done = written(start.select("_g", folded.alias("_f")), "folded")
        kept.append(done.select("_g", F.explode("_f.kept").alias("_k")))
        state = done.select("_g", F.col("_f.total").alias("_total"))
    if not kept:
        return rows.where(F.lit(False))
    chosen = kept[0]
    for c in kept[1:]:
        chosen = chosen.unionByName(c)
    same = F.col("f._g").eqNullSafe(F.col("c._g")) & (F.col("f._k") == F.col("c._k"))
    return fit.alias("f").join(chosen.alias("c"), same, "left_semi").select(*plain.columns).toDF(*names)


def captures(responses: DataFrame) -> DataFrame:
    """Pages with captures (feed_id, url, captured: array of url, body, headers, status_code) to the admitted captures, one row each.

    feed_id, page_url, position, url, body, headers, status_code.
    """
    each = responses.select("feed_id", F.col("url").alias("page_url"), F.posexplode("captured").alias("position", "c"))
    flat = each.select("feed_id", "page_url", "position", F.coalesce("c.url", F.lit("")).alias("url"), "c.body", "c.headers", "c.status_code")
    return within_budget(flat, "feed_id", ["position"])
