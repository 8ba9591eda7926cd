"""A training-corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. What each stage does with odd rows:

* quality rules: null and empty texts have no words and go; null ids and sources stay; repeated rows are judged alike.
* near-dedup: one row of each group of five-word Jaccard similarity 4/5 or more stays, that of the least id (null last);
  of repeated rows one stays; texts without a word are one group.
* suffix-array dedup: repeated passages of 200 bytes or more go from all texts; a text with nothing left goes, too.
* mixing: a row may stay once or twice or go, as its source's target has it; a null source is a source of its own; rows
  of size 0 go; equal rows are one item with a multiplicity.
* packing: a null text is a piece of one token.

Very long texts are read whole by every stage, ties are broken by content, empty tables give empty results, and columns
beyond those of documents pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedweave.llm import best_fit_packing, quality_rules, simhash_dedup, source_mixing, suffix_dedup
from feedweave.llm.common import documents, materialize

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("source_mixing", source_mixing.stage),
    ("best_fit_packing", best_fit_packing.stage),
]

#: Fingerprints, suffix arrays and random rounding have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
