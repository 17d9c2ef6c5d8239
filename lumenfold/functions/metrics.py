"""Performance metrics over prediction tables.

A prediction table has grouping keys, the true ``y`` and ``pred`` (label), ``dval`` or ``prob``; class 1 is positive.
Every metric is one aggregation over the keys. Divisions by zero give NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def nan() -> Column:
    return F.lit(float("nan"))

BINARY_ONLY = ("auc", "dval", "tval")
CONTINUOUS = ("auc", "dval", "tval", "roc")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(nan())


def label_of(score: Column, output: str) -> Column:
    """Class label of a decision value or probability; ties go to class 1."""
    return F.when((score if output == "dval" else score - 0.5) < 0, 2).otherwise(1)


def accuracy(df: DataFrame, keys: Sequence[str], output: str = "clabel") -> DataFrame:
    """From labels, predictions of 0 count as missing; from scores, a tie at the threshold is wrong for either class."""
    if output == "clabel":
        hit, n = F.sum((F.col("pred") == F.col("y")).cast("int")), F.sum((F.col("pred") != 0).cast("int"))
    else:
        score = F.col("dval") if output == "dval" else F.col("prob") - 0.5
        hit, n = F.sum((score * (F.lit(1.5) - F.col("y")) > 0).cast("int")), F.count(F.lit(1))
    return df.groupBy(*keys).agg(ratio(hit, n).alias("perf"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, keys: Sequence[str], score: str = "dval") -> DataFrame:
    """Mann-Whitney from midranks: scores are counted per distinct value first, so a group never meets in one task unless
    its distinct scores do."""
    per = df.groupBy(*keys, score).agg(F.sum((F.col("y") == 1).cast("bigint")).alias("p"), F.sum((F.col("y") == 2).cast("bigint")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = per.withColumn("won", F.col("p") * (below + F.col("q") * F.lit(0.5)))
    return won.groupBy(*keys).agg(ratio(F.sum("won"), F.sum("p") * F.sum("q")).alias("perf"), F.sum(F.col("p") + F.col("q")).alias("n"))


def counts(df: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Confusion counts n11 .. nCC as columns n_i_j (row true, column predicted)."""
    cells = [F.sum(((F.col("y") == i) & (F.col("pred") == j)).cast("bigint")).alias(f"n_{i}_{j}") for i in range(1, classes + 1) for j in range(1, classes + 1)]
    return df.groupBy(*keys).agg(*cells, F.count(F.lit(1)).alias("n"))


def _sum(names: Sequence[str]) -> Column:
    return sum((F.col(n) for n in names), F.lit(0))


def confusion(df: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Rows (keys, class_i, class_j, perf): normalised by the true class."""
    c = counts(df, keys, classes)
    r = range(1, classes + 1)
    cells = F.array(*[F.struct(F.lit(i).alias("class_i"), F.lit(j).alias("class_j"), ratio(F.col(f"n_{i}_{j}"), _sum([f"n_{i}_{k}" for k in r])).alias("perf")) for i in r for j in r])
    return c.select(*keys, "n", F.explode(cells).alias("cell")).select(*keys, "n", "cell.*")


def per_class(df: DataFrame, keys: Sequence[str], classes: int, kind: str) -> DataFrame:
    """precision, recall or f1. Two classes: of class 1; more: one row per class (``class_i``)."""
    c = counts(df, keys, classes)
    r = range(1, classes + 1)

    def value(i: int) -> Column:
        precision = ratio(F.col(f"n_{i}_{i}"), _sum([f"n_{k}_{i}" for k in r]))
        recall = ratio(F.col(f"n_{i}_{i}"), _sum([f"n_{i}_{k}" for k in r]))
        if kind == "precision":
            return precision
        return recall if kind == "recall" else ratio(2 * precision * recall, precision + recall)

    if classes == 2:
        return c.select(*keys, "n", value(1).alias("perf"))
    cells = F.array(*[F.struct(F.lit(i).alias("class_i"), value(i).alias("perf")) for i in r])
    return c.select(*keys, "n", F.explode(cells).alias("cell")).select(*keys, "n", "cell.*")


def kappa(df: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    c = counts(df, keys, classes)
    r = range(1, classes + 1)
    n = F.col("n").cast("double")
    observed = _sum([f"n_{i}_{i}" for i in r]) / n
    expected = sum((_sum([f"n_{i}_{k}" for k in r]).cast("double") * _sum([f"n_{k}_{i}" for k in r]) for i in r), F.lit(0.0)) / (n * n)
    return c.select(*keys, "n", ratio(observed - expected, 1 - expected).alias("perf"))


def mean_dval(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean decision value of each class, NaN left out."""
    return df.groupBy(*keys, F.col("y").alias("class_i")).agg(F.avg(F.nanvl("dval", F.lit(None).cast("double"))).alias("perf"), F.count(F.lit(1)).alias("n"))


def tval(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-sample t of decision values with pooled variance."""
    of = lambda f, c: f(F.when(F.col("y") == c, F.col("dval")))
    a = df.groupBy(*keys).agg(*[of(f, c).alias(f"{n}{c}") for c in (1, 2) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (pooled > 0)
    return a.select(*keys, F.when(ok, (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).otherwise(nan()).alias("perf"), (F.col("n1") + F.col("n2")).alias("n"))


def regression(df: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """mse, mae or r_squared of ``pred`` against ``y``; r_squared is 1 - var(pred - y) / var(y)."""
    d = F.col("pred") - F.col("y")
    agg = {"mse": F.avg(d * d), "mae": F.avg(F.abs(d)), "r_squared": 1 - ratio(F.var_samp(d), F.var_samp("y"))}[kind]
    return df.groupBy(*keys).agg(agg.alias("perf"), F.count(F.lit(1)).alias("n"))


def evaluate(df: DataFrame, metric: str, keys: Sequence[str], output: str = "clabel", classes: int = 2) -> DataFrame:
    """Any metric by name."""
    if metric in BINARY_ONLY and classes != 2:
        raise ValueError(f"{metric} needs two classes")
    if metric in ("accuracy", "acc"):
        return accuracy(df, keys, output)
    if metric in ("confusion", "precision", "recall", "f1", "kappa") and output != "clabel":
        df = df.withColumn("pred", label_of(F.col(output), output))
    if metric == "confusion":
        return confusion(df, keys, classes)
    if metric in ("precision", "recall", "f1"):
        return per_class(df, keys, classes, metric)
    if metric == "kappa":
        return kappa(df, keys, classes)
    if metric == "auc":
        return auc(df, keys, output if output != "clabel" else "dval")
    if metric == "dval":
        return mean_dval(df, keys)
    if metric == "tval":
        return tval(df, keys)
    if metric in ("mse", "mae", "r_squared", "mean_squared_error", "mean_absolute_error"):
        return regression(df, keys, {"mean_squared_error": "mse", "mean_absolute_error": "mae"}.get(metric, metric))
    if metric in ("none", None):
        return df
    raise ValueError(f"unknown metric {metric}")


def fold_average(perf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over folds and repeats weighted by test samples (a NaN fold adds nothing, its samples count); plain deviation."""
    mean = ratio(F.sum(F.nanvl(F.col("perf") * F.col("n"), F.lit(0.0))), F.sum("n"))
    std = F.coalesce(F.stddev_samp(F.nanvl("perf", F.lit(None).cast("double"))), nan())
    return perf.groupBy(*keys).agg(mean.alias("perf"), std.alias("perf_std"))
