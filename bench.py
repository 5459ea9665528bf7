"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from seekwell import queries as own

NAMES = ["bm25_search", "knn_items", "hybrid_search", "phrase_exact", "phrase_fuzzy", "usage_grouping_sets", "vector_reuse", "rolling_hour_count", "library_audit"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    own.QUERIES["usage_totals"](spark, d).collect()  # the session's first query also starts it
    took = {}
    for name in sys.argv[1:] or NAMES:
        began = time.perf_counter()
        own.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
