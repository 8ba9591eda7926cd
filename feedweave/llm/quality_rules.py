"""Quality rules (operator 9): decision lists learned by sequential covering, emitted as ordered Spark conditionals.

``text_statistics`` derives per-document statistics with DataFrame functions only. ``learn`` grows and prunes threshold
conjunctions for the rejected class on labelled statistics (one conjunction after another; the rows a rule covers leave
the set), and ``verdict`` turns the list into one ``CASE WHEN`` expression, so applying it stays inside codegen and needs
no shuffle.

Defined cases: null text counts as empty (no words, so base_failed); null doc_id is kept as a row; very long texts are
read whole; documents with no label do not take part in learning; an empty label table or one class only gives an empty
list (all kept); an empty table gives an empty result; repeated rows give repeated results; labels that repeat a document
count once per row; ids may be numbers or texts. ``annotate`` passes all other columns through, whatever their names; a
column named like one of its results is replaced by it.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import WS_CHARS, documents, let, plain_names, whole_text, words_of

SYMBOLS = "#*$%&|<>"
#: Bounded sample of labelled rows used for learning (the smallest by a hash of their id).
FIT_ROWS = 12_000
FEATURES = ("mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "n_words")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are 64-bit hashes; only texts with a repeated hash sort (hash, place) pairs, so the cost is n log n at worst.
    """
    n = F.size(words)
    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def near(pairs: Column) -> Column:
        def place(p: Column, k: Column) -> Column:
            same = (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"])
            return F.when(same, p["i"])

        return F.array_sort(F.array_compact(F.transform(pairs, place)))

    def total(hit: Column) -> Column:
        steps = F.transform(hit, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(hit, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(pairs, near), total)

    by_hash = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(n < 4, F.lit(0)).otherwise(by_hash).cast("long")


def text_statistics(df: DataFrame) -> DataFrame:
    """df plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and shares in the struct ``_f``."""
    text = whole_text()
    blank = F.lit(WS_CHARS)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0)
    df = df.withColumns({"_words": words_of(text), "_lines": lines, "_bare": F.translate(text, WS_CHARS, "")})
    counts = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length("_bare").cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "_distinct": F.size(F.array_distinct("_words")).cast("double"),
        "_n_lines": F.size("_lines").cast("double"),
        "_upper": F.length(F.regexp_replace("_bare", r"[^\p{Lu}]+", "")).cast("double"),
    }
    # a generator of one row: later filters stay above it, so they do not repeat the work below
    df = df.withColumn("_s", F.explode(F.array(F.struct(*[c.alias(k) for k, c in counts.items()]))))
    df = df.withColumns({k: F.col(f"_s.{k}") for k in counts})
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    shares = F.struct(
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1.0))).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("_distinct") / n).alias("distinct_share"),
        (F.col("_upper") / chars).alias("upper_share"),
        F.col("n_words").cast("double").alias("n_words"),
    )
    return df.withColumn("_f", shares).drop("_words", "_lines", "_bare", "_distinct", "_n_lines", "_upper", "_s")


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


@dataclass
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) that rejects what it covers."""

    terms: list[tuple[str, str, float]] = field(default_factory=list)
    covered: int = 0
    wrong: int = 0

    def holds(self, row: dict) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.terms)

    def column(self, source: str = "_f") -> Column:
        out = F.lit(True)
        for f, op, t in self.terms:
            c = F.col(f"{source}.{f}")
            out = out & ((c <= t) if op == "<=" else (c > t))
        return out


def _best_term(pos: list[dict], neg: list[dict]) -> tuple[float, tuple[str, str, float]] | None:
    """The threshold with the largest information gain of the covered positives (ties: earlier feature, smaller threshold)."""
    p0, n0 = len(pos), len(neg)
    base = math.log2(p0 / (p0 + n0))
    best = None
    for f in FEATURES:
        rows = sorted([(r[f], 1) for r in pos] + [(r[f], 0) for r in neg])
        p = n = 0
        for k, (v, y) in enumerate(rows):
            p, n = p + y, n + 1 - y
            if k + 1 == len(rows) or rows[k + 1][0] == v:
                continue
            cut = (v + rows[k + 1][0]) / 2
            for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                if a:
                    gain = a * (math.log2(a / (a + b)) - base)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, (f, op, cut))
    return best


def learn(
    rows: list[dict], *, target: str = "bad", min_cover: int = 5, min_precision: float = 0.97, max_terms: int = 4
) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, drop what it covers, repeat.

    A rule is kept only if its precision on growing and pruning rows together reaches min_precision; learning ends with
    the first that does not. Rows are dicts of FEATURES and the 0/1 target.
    """
    rules: list[Rule] = []
    left = list(rows)
    while True:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        pos, neg = [r for r in grow if r[target]], [r for r in grow if not r[target]]
        if len(pos) < min_cover or not neg:
            break
        rule = Rule()
        p, n = pos, neg
        while n and len(rule.terms) < max_terms:
            found = _best_term(p, n)
            if found is None or found[0] <= 1e-9:
                break
            rule.terms.append(found[1])
            p, n = [r for r in p if rule.holds(r)], [r for r in n if rule.holds(r)]

        def worth(terms: list) -> float:
            cut = Rule(terms)
            got = [r[target] for r in prune if cut.holds(r)]
            return (2 * sum(got) - len(got)) / max(1, len(got))

        while len(rule.terms) > 1 and worth(rule.terms[:-1]) >= worth(rule.terms):
            rule.terms.pop()
        got = [r[target] for r in left if rule.holds(r)]
        rule.covered, rule.wrong = len(got), len(got) - sum(got)
        if not rule.terms or sum(got) < min_cover or sum(got) < min_precision * len(got):
            break
        rules.append(rule)
        left = [r for r in left if not rule.holds(r)]
    return rules


def verdict(rules: list[Rule], source: str = "_f") -> Column:
    """The list as one ordered conditional: the first rule that holds rejects, else keep."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(r.column(source), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from the labelled documents that pass the base checks; at most fit_rows of them, lowest id hash first.

    Rows that repeat an id are one document here, that of the least statistics, so no more than fit_rows rows are gathered.
    """
    picked = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most fit_rows small rows
    stats = text_statistics(joined).where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    got = stats.groupBy("doc_id", (F.col("quality") == 0).cast("int").alias("bad")).agg(F.min("_f").alias("_f"))
    rows = [r["_f"].asDict() | {"bad": r["bad"], "id": r["doc_id"]} for r in got.collect()]
    rows.sort(key=lambda r: (hash_order(r["id"]), tuple(r[f] for f in FEATURES)))
    return learn(rows)


def hash_order(x: int | str) -> int:
    """A fixed mixing of ids, so that growing and pruning rows alternate without regard to id order."""
    x = x if isinstance(x, int) else zlib.crc32(str(x).encode())
    return (x * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) ^ (x >> 7)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def annotate(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs plus the statistics, base_failed and kept."""
    names = docs.columns
    plain = plain_names(names, ("doc_id", "text"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    df = text_statistics(docs.toDF(*plain)).withColumns({"base_failed": failed, "kept": ~failed & verdict(rules)})
    return df.select(*[F.col(p).alias(x) for p, x in zip(plain, names, strict=True) if x not in RESULTS], *RESULTS)


OUT = ("doc_id", *RESULTS)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return annotate(docs, rules).select(*OUT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents the list or the base checks reject go."""
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text")  # own columns keep their values, whatever their names
    return annotate(whole, rules).where("kept").select("_row.*")
