"""Spelling variant grouping (operator 11): a trie self-join with active-node sets.

1. Words are counted in partitions, then over all rows; the vocabulary is a table.
2. Two words one edit apart share the first or the last half of the shorter one. So the vocabulary trie is partitioned by
   the first half of each word, once as it is and once reversed; a word of length L goes to the partition of its own size
   and, as a longer partner, to that of size L - 1. A partition is a trie whose root is the shared half.
3. In a partition, every node hands its children its active nodes, those whose string is one edit from its own: they follow
   the child's letter; its greater siblings (a replaced letter) and its own children (an inserted one) join them. Where a
   node and an active node both end a word, the pair is emitted. Words are worked off partition by partition from a sorted
   stream, so a task holds one trie of at most LIMIT words.
4. A prefix with more words than that is split at its first branching node: the pairs born at that node must go on alike,
   so they are met by a join on the node and what follows the edit, and the node's children become partitions. This
   repeats while a prefix is too large; no word or pair is left out.
5. A word's form is its near word of largest count, if that has twice its own. Roots are found by pointer doubling: each
   round replaces what a word points to by what that points to.

Defined cases: null text has no runs; a null doc_id reads as empty where runs are hashed; ties of count go to the smaller
word in code-point order; repeated rows count again; an empty table gives an empty result; texts are read whole, long ones
run by run; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import crc32_sql, discard, documents, materialize

#: Words of one trie.
LIMIT = 1 << 14
#: Words that a partition counts before it hands them on.
HELD = 1 << 18
LONG_TEXT = 1 << 22
RUNS = re.compile("[a-zÀ-ÿ]+")
PART = ["reversed", "size", "prefix"]
PAIR_DDL = "reversed int, size int, a string, n_a long, b string, n_b long"


def runs_of(text: str) -> Counter:
    """Lower-cased runs of a text and how often it has them."""
    low = text.encode().lower().decode()  # bytes: A-Z only
    if len(low) < LONG_TEXT:
        return Counter(RUNS.findall(low))
    return Counter(m.group() for m in RUNS.finditer(low))


def misspelt(doc_id: object, run: str, every: int) -> str:
    """The run without one code point, if its hash with the document's id is a multiple of every."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int = 97, least: int = 5) -> DataFrame:
    """word, n: partial counts of words of at least so many code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for w, n in runs_of(text.as_py() or "").items():
                    if len(w) >= least:
                        word = misspelt(doc_id, w, every)
                        if len(word) >= least:
                            found[word] += n
                if len(found) > HELD:
                    yield out()
                    found.clear()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def near_words(words: list[str], size: int, skip: int) -> Iterable[tuple[int, int]]:
    """Index pairs of words one edit apart that share their first skip letters: the first of length size, the second of size or size + 1.

    words are distinct and all have the same first skip letters.
    """
    kids: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    home: list[bool] = [True]  # on the way to a word of length size
    for k, word in enumerate(words):
        at, own = 0, len(word) == size
        for c in word[skip:]:
            below = kids[at].get(c)
            if below is None:
                below = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
                home.append(own)
            elif own:
                home[below] = True
            at = below
        ends[at] = k
    out = []
    # a node and the nodes whose string is one replaced or inserted letter from its own
    open_: list[tuple[int, list[int]]] = [(0, list(kids[0].values()))]
    while open_:
        node, active = open_.pop()
        if ends[node] >= 0:
            out += [(ends[node], ends[v]) for v in active if ends[v] >= 0]
        rest = list(kids[node].items())
        for i, (c, child) in enumerate(rest):
            if home[child]:
                follow = {w for v in active if (w := kids[v].get(c)) is not None}
                follow.update(s for _, s in rest[i + 1 :])
                follow.update(kids[child].values())
                open_.append((child, list(follow)))
    return out


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each partition of a stream sorted by partition."""
    part, words, counts = None, [], []
    out: list[tuple] = []

    def close() -> None:
        if len(words) > 1:
            kind, size, prefix = part
            out.extend((kind, size, words[a], counts[a], words[b], counts[b]) for a, b in near_words(words, size, len(prefix)))

    def rows() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["reversed", "size", "a", "n_a", "b", "n_b"])

    for b in batches:
        for *key, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != part:
                close()
                part, words, counts = key, [], []
            words.append(word)
            counts.append(n)
        yield rows()
        out.clear()
    close()
    yield rows()


def partitioned(vocabulary: DataFrame, least: int) -> DataFrame:
    """reversed, size, prefix, word, n: each word in its partitions, reversed words last letter first."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("reversed"), F.col("word").alias("word")), F.struct(F.lit(1).alias("reversed"), F.reverse("word").alias("word"))))
    forms = vocabulary.select(both.alias("f"), "n").select("f.*", "n")
    sized = forms.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1))).where(F.col("size") >= least)
    return sized.select("reversed", "size", F.left("word", F.floor(F.col("size") / 2).cast("int")).alias("prefix"), "word", "n")


def _shared(a: str, b: str):
    """Number of first letters that two columns share."""
    short = F.least(F.length(a), F.length(b))
    differ = F.transform(F.sequence(F.lit(1), short), lambda i: F.substr(F.col(a), i, F.lit(1)) != F.substr(F.col(b), i, F.lit(1)))
    at = F.array_position(differ, True)
    return F.when(at > 0, at - 1).otherwise(short).cast("int")


def born_at(rows: DataFrame) -> DataFrame:
    """Near words that part at the end of their prefix: equal in what follows the edit."""
    at = F.length("prefix")
    after, here = F.substr("word", at + 2), F.substr("word", at + 1)
    own = F.length("word") == F.col("size")
    left = rows.where(own)
    keys = [*PART, "inserted", "rest"]
    a = left.select(*PART, F.explode(F.array(F.struct(F.lit(0).alias("inserted"), after.alias("rest")), F.struct(F.lit(1).alias("inserted"), here.alias("rest")))).alias("k"), "word", "n").select(*PART, "k.*", F.col("word").alias("a"), F.col("n").alias("n_a"))
    a = a.where((F.col("inserted") == 1) | (F.length("a") > at))
    b = rows.where(F.length("word") > at).select(*PART, F.when(own, 0).otherwise(1).alias("inserted"), after.alias("rest"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    # words that go on with the same letter meet again further down
    apart = F.substr(F.col("a"), at + 1, F.lit(1)) != F.substr(F.col("b"), at + 1, F.lit(1))
    return a.join(b, keys).where(F.when(F.col("inserted") == 1, apart).otherwise(F.col("a") < F.col("b"))).select("reversed", "size", "a", "n_a", "b", "n_b")


def near_pairs(vocabulary: DataFrame, least: int = 5, limit: int = LIMIT) -> DataFrame:
    """a, n_a, b, n_b: every pair of words one inserted, deleted or replaced code point apart, once."""
    rows, found = partitioned(vocabulary, least), []
    while True:
        sizes = rows.groupBy(*PART).agg(F.count("*").alias("_n"), F.min("word").alias("_lo"), F.max("word").alias("_hi")).where(F.col("_n") > limit)
        heavy = materialize(sizes.select(*PART, F.left("_lo", _shared("_lo", "_hi")).alias("_node")), "heavy")
        if heavy.isEmpty():
            break
        split = rows.join(heavy, PART).withColumn("prefix", F.col("_node")).drop("_node")
        split = materialize(split, "split")
        found.append(born_at(split))
        deeper = split.where(F.length("word") > F.length("prefix")).withColumn("prefix", F.left("word", F.length("prefix") + 1))
        rows = materialize(rows.join(heavy, PART, "left_anti").unionByName(deeper), "parts")
    found.append(rows.repartition(*PART).sortWithinPartitions(*PART, "word").select(*PART, "word", "n").mapInArrow(_tries, PAIR_DDL))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    back = [F.when(F.col("reversed") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("a", "b")]
    pairs = pairs.select("reversed", "size", *back, "n_a", "n_b")
    half = F.floor(F.col("size") / 2).cast("int")
    # what shares its first half has been met in the trie of words as they are
    return pairs.where((F.col("reversed") == 0) | (F.left("a", half) != F.left("b", half))).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms (rows word, form) ends."""
    table = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while table.where("moved").limit(1).count():
        to = table.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = table.join(to, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        before, table = table, materialize(step, "roots")
        discard(before)
    return table.select("word", "root")


def variants(docs: DataFrame, every: int = 97, least: int = 5, seen: int = 3, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least `least` code points and `seen` occurrences."""
    counted = word_counts(docs, every, least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)
    vocabulary = materialize(counted, "vocabulary")
    pairs = materialize(near_pairs(vocabulary, least, limit), "near")
    links = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("form")).alias("near"))
    links = links.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("n"), F.col("a").alias("form")).alias("near")))
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    high = -F.col("near.n") >= 2 * F.col("n")
    table = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(high, F.col("near.form")).alias("form"), F.when(high, -F.col("near.n")).alias("form_n"))
    table = materialize(table, "forms")
    ends = roots(table.where("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


ORACLE = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("doc_id || ':' || run")} AS h FROM runs WHERE length(run) >= 5),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
vocabulary AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (
    SELECT word, n, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS MATERIALIZED (
    SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
    UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocabulary v ON v.word = c.l || c.r
    UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocabulary v ON v.word = c.l || c.r),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY word),
forms AS MATERIALIZED (
    SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
    FROM vocabulary v LEFT JOIN best USING (word)),
way AS (
    SELECT word, word AS stop FROM forms
    UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.stop WHERE forms.form IS NOT NULL),
ends AS (SELECT way.word, stop AS root FROM way JOIN forms ON forms.word = stop AND forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
