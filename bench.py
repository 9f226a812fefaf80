"""Headline queries, the median of three timed runs each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from spanmill.queries import QUERIES

HEADLINE = [
    "total_overlaps", "count", "search_items", "coverage", "has_overlaps", "merge_overlaps", "intersection", "difference", "gaps", "unique",
    "search_idxs_batch", "count_keyless", "search_values_doubles", "count_skewed", "search_idxs_skewed", "count_2d",
]
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):  # the first compiles
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "interval queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
