"""Plans that hold at size: no table of elements goes whole through the driver, and pages made of a small table are dealt over the cores."""

import pytest
from pyspark.sql import functions as F

from feedweave import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["semantic_roots", "chosen_links", "captured_by_path", "listed_links", "cluster_overlaps", "cluster_scores", "page_summaries", "cluster_feed"])
def test_no_broadcast(spark, name):
    """Tables of alike pages are tiny by their files; by them Spark would send millions of rows to every executor."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_pages_are_dealt(spark):
    cores = spark.sparkContext.defaultParallelism
    part = catalog.table(spark, SF, "part")
    assert part.rdd.getNumPartitions() < cores
    pages = catalog.bodies(part, "p_partkey", "<p>%1$d %2$s</p>", "p_partkey", "p_name")
    assert pages.rdd.getNumPartitions() == catalog.part_pages(spark, SF, F.col("p_size").cast("string")).rdd.getNumPartitions() == cores
    assert pages.columns == ["feed_id", "url", "body"] and pages.count() == part.count()
