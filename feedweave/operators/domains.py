"""Registrable domains by a table of public-suffix rules.

Rules have the usual list form: a suffix, ``*.`` before it (any one label more), or ``!`` before it (an exception to a
wildcard); ``//`` starts a comment. The rule of most labels decides, an exception before any other, and without a rule the
last label is the suffix. Every end of a host is looked up in the rule table by an equi-join, once for each distinct host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.functions import urls

ADDRESS = r"^\[?[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]?$|^\d{1,3}(\.\d{1,3}){3}$"


def rules(lines: DataFrame) -> DataFrame:
    """Lines (value) of a rule list to suffix, kind (``!``, ``*`` or empty)."""
    line = F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1))
    kept = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("//")))
    kind = F.when(F.startswith(F.col("line"), F.lit("!")), "!").when(F.startswith(F.col("line"), F.lit("*.")), "*").otherwise("")
    return kept.select(F.regexp_replace("line", r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind")).distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return rules(spark.read.text(path))


def host_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Distinct hosts (host) to host, domain; a host that is a suffix or an address is its own."""
    labels, n = F.split("host", r"\."), F.size(F.split("host", r"\."))
    named = hosts.where(F.col("host").isNotNull()).distinct()
    ends = named.where(~F.regexp_like("host", F.lit(ADDRESS))).select("host", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    ends = ends.withColumn("suffix", F.array_join(F.slice(labels, n - F.col("k") + 1, F.col("k")), "."))
    hits = ends.join(suffixes, "suffix").select("host", "k", "kind", n.alias("n"))
    size = F.when(F.col("kind") == "*", F.col("k") + 1).when(F.col("kind") == "", F.col("k"))
    found = hits.groupBy("host").agg(F.max(F.when(F.col("kind") == "!", F.col("k") - 1)).alias("except"), F.max(F.when(size <= F.col("n"), size)).alias("most"))
    tail = F.coalesce("except", "most", F.lit(1)) + 1
    own = F.regexp_like("host", F.lit(ADDRESS)) | (n < tail)
    return named.join(found, "host", "left").select("host", F.when(own, F.col("host")).otherwise(F.array_join(F.slice(labels, n - tail + 1, tail), ".")).alias("domain"))


def with_domain(df: DataFrame, suffixes: DataFrame, url: str = "url", into: str = "domain") -> DataFrame:
    """df plus the registrable domain of a URL column."""
    keyed = df.withColumn("_host", urls.part(F.col(url), "host"))
    found = host_domains(keyed.select(F.col("_host").alias("host")), suffixes)
    return keyed.join(found.select(F.col("host").alias("_host"), F.col("domain").alias(into)), "_host", "left").drop("_host")
