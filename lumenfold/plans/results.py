"""Result tables: selection, combination, parameter grids and plot descriptors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def select_metric(result: DataFrame, metric: str) -> DataFrame:
    return result.where(F.col("metric") == metric)


def combine(results: Sequence[DataFrame], how: str, keys: Sequence[str]) -> DataFrame:
    """``merge``: all rows with the number of their result; ``average``: mean and deviation over results."""
    numbered = [r.withColumn("result", F.lit(i + 1)) for i, r in enumerate(results)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    if how == "merge":
        return both
    if how != "average":
        raise ValueError("combine with merge or average")
    return both.groupBy(*keys).agg(F.avg("perf").alias("perf"), F.stddev_samp("perf").alias("perf_std"), F.count(F.lit(1)).alias("n_results"))


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations of parameter values (a parameter table, built on the driver)."""
    return spark.createDataFrame(list(product(*values.values())), list(values))


def plot_descriptor(metric: str, dims: Sequence[str], n_classes: int = 2, has_std: bool = True) -> dict:
    """How to draw a result: kind by the number of its dimensions, and the line of chance."""
    kind = "confusion" if metric == "confusion" else {0: "bar", 1: "line", 2: "image"}.get(len(dims), "dots")
    chance = {"accuracy": 1 / n_classes, "acc": 1 / n_classes, "auc": 0.5, "tval": 0.0, "kappa": 0.0, "r_squared": 0.0}.get(metric)
    return {"kind": kind, "x": dims[0] if dims else None, "y": dims[1] if len(dims) > 1 else metric, "chance": chance, "error_band": has_std and kind in ("bar", "line"), "title": metric}
