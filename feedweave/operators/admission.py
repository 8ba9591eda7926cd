"""Admission of candidate articles, deduplication, tier short-circuit, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import destinations, texts, urls
from feedweave.functions import lexicon as L
from feedweave.operators import domains


def reasons(candidates: DataFrame, page_url: Column | None = None, *, keep_different_domain: bool = False, by: str = "feed_id", pos: str = "position", suffixes: DataFrame | None = None) -> DataFrame:
    """candidates (by, pos, id, title, description, url, page_url) plus reason: the first test it fails, null if admitted.

    suffixes: a table of public-suffix rules; without it a short list of two-label suffixes tells domains.
    """
    page = F.col("page_url") if page_url is None else page_url
    if suffixes is not None and not keep_different_domain:
        candidates = domains.with_domain(candidates.withColumn("_page", page), suffixes, "url", "_own_domain")
        candidates = domains.with_domain(candidates, suffixes, "_page", "_page_domain")
    df = candidates.withColumn("_identity", urls.without_fragment(F.col("url")))
    some = F.coalesce(F.trim("title"), F.lit("")) != ""
    said = F.coalesce(F.trim("description"), F.lit("")) != ""
    valid = F.col("url").isNotNull() & (some | said) & F.col("id").isNotNull()
    first = F.row_number().over(Window.partitionBy(by, valid, "_identity").orderBy(pos)) == 1
    df = df.withColumns({"_valid": valid, "_first": first & F.col("_identity").isNotNull(), "_facts": destinations.facts(F.col("url"))})
    f = F.col("_facts")
    excluded = f["high_confidence_junk_path"] | f["high_confidence_utility_destination"] | (f["utility_path"] & ~f["content_path"] & ~f["strong_post_suffix"])
    other = F.lit(False) if keep_different_domain else F.col("_own_domain") != F.col("_page_domain") if suffixes is not None else urls.domain(F.col("url")) != urls.domain(page)
    reason = (
        F.when(~F.col("_valid"), "invalid")
        .when(~F.col("_first"), "duplicate_url")
        .when(~F.coalesce(urls.part(F.col("url"), "scheme").isin("http", "https"), F.lit(False)), "bad_scheme")
        .when(F.col("_identity") == urls.without_fragment(page), "self_link")
        .when(other, "different_domain")
        .when(excluded, "excluded_destination")
        .when(F.col("title").isNotNull() & texts.junk_title_reason(F.trim("title")).isNotNull(), texts.junk_title_reason(F.trim("title")))
        .when(F.col("title").isNotNull() & (texts.word_count(F.col("title")) < L.MIN_WORDS), "low_word_count")
    )
    return df.withColumn("reason", reason).drop("_identity", "_valid", "_first", "_facts", "_page", "_own_domain", "_page_domain")


def tallies(df: DataFrame, by: str, what: str) -> DataFrame:
    """One row per group: a map from value to count."""
    counts = df.where(F.col(what).isNotNull()).groupBy(by, what).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(what, "n")))).alias("tallies"))


def fingerprint(url: Column, ident: Column, guid: Column, title: Column, description: Column) -> Column:
    """url and id, else id, else guid, title and description, absent parts left out."""
    return F.coalesce(
        F.when(url.isNotNull(), F.concat_ws("#!/", url, ident)),
        F.when(F.coalesce(ident, F.lit("")) != "", ident),
        F.when(F.coalesce(guid, F.lit("")) != "", F.concat_ws("#!/", guid, title, description)),
    )


def dedup(articles: DataFrame, by: str = "feed_id", pos: str = "position") -> DataFrame:
    """The first article of each fingerprint; rows without one stay."""
    key = fingerprint(*[F.col(c) for c in ("url", "id", "guid", "title", "description")])
    ranked = articles.withColumn("_key", key).withColumn("_k", F.row_number().over(Window.partitionBy(by, "_key").orderBy(pos)))
    return ranked.where("_key is null or _k = 1").drop("_key", "_k")


def united(selected: DataFrame, found: DataFrame, by: str = "feed_id", pos: str = "position") -> DataFrame:
    """Selector articles, then automatic ones, positions counted on, the first of each fingerprint kept."""
    both = selected.withColumn("_part", F.lit(0)).unionByName(found.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy("_part", pos)
    return dedup(both.withColumn(pos, (F.row_number().over(order) - 1).cast("int")).drop("_part"), by, pos)


def run_tiers(candidates: DataFrame, limit: int, last_tier: int, by: str = "page_id") -> DataFrame:
    """Rows of the tiers that run: a tier stops at limit earlier rows of which limit are admitted; the last needs none admitted.

    candidates: by, tier, admitted. Per-tier counts are summed over earlier tiers; a stopped tier stops all later ones.
    """
    per = candidates.groupBy(by, "tier").agg(F.count("*").alias("raw"), F.count_if("admitted").alias("adm"))
    before = Window.partitionBy(by).orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"raw_before": F.coalesce(F.sum("raw").over(before), F.lit(0)), "adm_before": F.coalesce(F.sum("adm").over(before), F.lit(0))})
    stopped = (F.col("raw_before") >= limit) & (F.col("adm_before") >= limit)
    skipped = (F.col("tier") == last_tier) & (F.col("adm_before") > 0)
    kept = per.where(~stopped & ~skipped).select(by, "tier")
    return candidates.join(kept, [by, "tier"], "left_semi")


def first_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows per key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
