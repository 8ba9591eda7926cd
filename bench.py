"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from feedweave import catalog

HEADLINE = ("flagship_article_feed", "nav_items", "node_histogram", "cleanup_reasons", "segment_scores", "description_rules", "json_feed_items", "dedup_dropped", "parse_time_rfc822", "pagination_urls")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - began

    times = {}
    for name in HEADLINE:
        once(name)  # warm-up
        times[name] = round(sorted(once(name) for _ in range(3))[1], 3)
    print(json.dumps({"metric": "headline queries, median of 3 after a warm-up", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
