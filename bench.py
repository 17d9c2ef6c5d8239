"""Headline queries, timed warm: prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lumenfold import catalog

NAMES = ["nb_across_time", "nb_time_by_time", "metric_auc", "metric_kappa", "multi_metric", "prep_zscore", "prep_impute_forward", "cv_kfold_stratified_lcg", "class_scatter", "ledoit_wolf", "lda_cv", "multiclass_lda_cv", "ridge_cv", "stat_ranksum", "stat_permutation_lcg"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in NAMES:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
