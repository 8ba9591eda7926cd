"""Chat formatting (operator 8): multi-party perspective rotation.

For every participant of a conversation (every role but system) the whole dialogue is rendered with that speaker as the
assistant and all others as named users; the mask lists the character spans [start, end) that the model is to learn,
which are the contents of the speaker's own turns. Turn template: ``<|name|>\\n`` + text + ``<|end|>\\n`` with name
``assistant``, ``system`` or ``user:<role>``.

A rendering comes in consecutive pieces of PART turns: ``part`` numbers them, ``start`` is a piece's first character
within the whole dialogue, and masks count from the dialogue's start, so the pieces of one speaker, joined in order, are
the dialogue with its mask (``dialogues`` does that). No task gathers more than the turns of one piece: rows are sorted
over ranges, so that a hot conversation lies in many partitions; a turn's number in its conversation is its place in its
range plus the counts of ranges before, and piece starts are running sums over pieces, whose rows hold counts only. The
result has a row for each piece and participant, so turns appear once per participant: roles are few, not one per turn.

Defined cases: null text counts as empty; null roles are the role ``unknown``; null turns come first; null conv_id is a
conversation of its own; ties in turn are ordered by role and text; repeated rows are repeated turns; a conversation of
system turns only gives no row; an empty table gives an empty result; very long texts are kept whole; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweave.llm.common import materialize

PART = 256
END = "<|end|>\n"
SPANS = "array<struct<start:bigint,end:bigint>>"
ACC = f"struct<at:bigint,spans:{SPANS}>"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and k, the turn's place in its conversation from 0, by turn, role and text."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    # equal rows may lie in any order, so a hash of their input place spreads even those
    spread = rows.withColumn("_any", F.xxhash64(F.monotonically_increasing_id()))
    ranged = spread.repartitionByRange(*keys, "_any").sortWithinPartitions(*keys, "_any").drop("_any")
    ranged = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "turns").withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row for each conversation and range that it lies in
    per = materialize(ranged.groupBy("conv_id", "_range").agg(F.count("*").alias("n"), F.min("_at").alias("first")), "ranges")
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = materialize(per.select("conv_id", "_range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "shifts")
    both = ranged.alias("r").join(shift.alias("s"), F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r._range") == F.col("s._range")))
    return both.select("r.conv_id", "turn", "role", "text", (F.col("_at") + F.col("shift")).alias("k"))


def render(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, speaker, start, n_turns, n_own, text, mask (array of start, end)."""
    rows = numbered(turns).select("conv_id", F.floor(F.col("k") / part).alias("part"), F.struct("k", "role", "text").alias("_t"))
    parts = materialize(rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("_t")).alias("_turns")), "parts")

    speakers = parts.select("conv_id", F.explode("_turns.role").alias("speaker")).where("speaker <> 'system'").distinct()
    # a piece's length for a speaker: that for nobody in particular, less what "assistant" is shorter than "user:" and the role
    plain = F.aggregate("_turns", F.lit(0).cast("long"), lambda a, t: a + F.length(_head(t, F.lit(None).cast("string"))) + F.length(t["text"]) + len(END))
    own = F.filter("_turns", lambda t: t["role"] == F.col("speaker"))
    sizes = parts.select("conv_id", "part", plain.alias("plain"), F.col("_turns.role").alias("roles"))
    both = sizes.alias("p").join(materialize(speakers, "speakers").alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))
    mine = F.size(F.filter("roles", lambda r: r == F.col("speaker")))
    both = both.select("p.conv_id", "part", "speaker", (F.col("plain") - mine * (F.length("speaker") + len("user:") - len("assistant"))).alias("size"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(both.select("conv_id", "part", "speaker", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("start")), "starts")

    each = parts.alias("p").join(starts.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("p.part") == F.col("s.part"))).select("p.conv_id", "p.part", "speaker", "start", "_turns")
    each = each.withColumn("_said", F.transform("_turns", lambda t: F.struct(_head(t, F.col("speaker")).alias("head"), t["text"].alias("text"), (t["role"] == F.col("speaker")).alias("own"))))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.length(t["head"])
        end = first + F.length(t["text"])
        span = F.array(F.struct(first.cast("long").alias("start"), end.cast("long").alias("end")))
        spans = F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + len(END)).cast("long").alias("at"), spans.alias("spans")).cast(ACC)

    zero = F.struct(F.col("start").alias("at"), F.array().cast(SPANS).alias("spans")).cast(ACC)
    text = F.array_join(F.transform("_said", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    return each.select("conv_id", "part", "speaker", "start", F.size("_said").cast("long").alias("n_turns"), F.size(own).cast("long").alias("n_own"), text.alias("text"), F.aggregate("_said", zero, step)["spans"].alias("mask"))


def _head(t: Column, speaker: Column) -> Column:
    name = F.when(t["role"] == speaker, F.lit("assistant")).when(t["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user:"), t["role"]))
    return F.concat(F.lit("<|"), name, F.lit("|>\n"))


def dialogues(rendered: DataFrame) -> DataFrame:
    """conv_id, speaker, text, mask: the pieces of each rendering in one row, for conversations that fit one."""
    whole = F.array_sort(F.collect_list(F.struct("part", "text", "mask"))).alias("p")
    return rendered.groupBy("conv_id", "speaker").agg(whole).select("conv_id", "speaker", F.array_join("p.text", "").alias("text"), F.flatten("p.mask").alias("mask"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return render(turns).withColumn("mask", spans)


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM t),
w AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
s AS (SELECT n.conv_id, k, k // {PART} AS part, speaker, role = speaker AS own, text,
             '<|' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user:' || role END || '|>' || chr(10) AS head
      FROM n JOIN w ON n.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (SELECT *, length(head) AS h, length(text) AS len,
             coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, speaker ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s)
SELECT conv_id, CAST(part AS BIGINT) AS part, speaker, CAST(min(pos) AS BIGINT) AS start, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(CAST(pos + h AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + h + len AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, part, speaker"""
