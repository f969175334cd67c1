"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS pick the data and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cubespark import plans

#: The cube statistics, geometry, scaling, splits and metrics that a session runs most.
HEADLINE = (
    "gap_heat_map", "statistics", "value_range", "chunk_stats", "insights", "split_chunk_windows", "split_chunk_overlap", "assign_mask", "drop_nan_masked",
    "fill_mean", "normalize", "standardize", "rand_split", "create_split", "process_chunk", "batches", "rmse", "median_ae_sklearn", "roc_auc", "f1_macro",
    "knn_predictors", "nearest_interpolation", "gapfill_svr", "ols_fit", "sgd_fit", "rechunk",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.load()[0]
    queries["value_range"](spark, folder).collect()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
