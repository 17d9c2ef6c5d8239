"""Significance of results: tests of one analysis (level 1) and of results of many subjects (level 2).

A permutation is a key, not a loop: the samples of all permutations are one tensor frame with ``perm`` as a further search
dimension, and the analysis runs on it as on any other. p is the share of permutations strictly beyond the real value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators.folds import dense_number
from ..sources.tensors import TensorFrame
from .analysis import AnalysisSpec, classify, regress
from .written import written


def permuted(t: TensorFrame, n_permutations: int, seed: int = 1) -> TensorFrame:
    """All permutations of the labels over the samples: search dimension ``perm`` (1..n), sample ids of their own.

    Every permutation keeps the number of samples of each label. The order of a permutation is that of hashed ids; one
    window holds the ids of one permutation.
    """
    samples = written(dense_number(t.df.select("sample_id", t.label).distinct(), "sample_id").select(F.col("rn").cast("bigint").alias("rn"), "sample_id", F.col(t.label).alias("y")))
    size = samples.count()
    perm = samples.select("sample_id", "rn").withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))))
    order = Window.partitionBy("perm").orderBy(F.xxhash64("sample_id", "perm", F.lit(seed)), "sample_id")
    drawn = perm.withColumn("rn2", F.row_number().over(order).cast("bigint")).select("sample_id", "perm", ((F.col("perm") - 1).cast("bigint") * size + F.col("rn")).alias("number"), F.col("rn2").alias("rn"))
    labels = drawn.join(samples.select("rn", F.col("y").alias(t.label)), "rn").drop("rn")
    data = t.df.drop(t.label).join(labels, "sample_id").drop("sample_id").withColumnRenamed("number", "sample_id")
    return TensorFrame(data, ("perm", *t.search), t.label)


def _run(t: TensorFrame, spec: AnalysisSpec, classes: int | None) -> DataFrame:
    return regress(t, spec) if spec.regression else classify(t, spec, classes)


def permutation_test(
    t: TensorFrame, spec: AnalysisSpec, n_permutations: int = 1000, correct: str = "none", critical: float | None = None, statistic: str = "mass",
    tail: int = 1, alpha: float = 0.05, full: bool = False, classes: int | None = None, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(positions with stat, p and mask; null distribution: perm, positions, stat) of a whole analysis of one metric.

    ``correct``: none, bonferroni (alpha over the number of positions) or cluster (positions beyond ``critical`` that touch
    are one cluster, compared with the extreme cluster of each permutation by ``mass`` or ``size``).
    """
    if correct not in ("none", "bonferroni", "cluster") or len(spec.metric) != 1:
        raise ValueError("one metric, and none, bonferroni or cluster correction")
    if (correct == "cluster") != (critical is not None):
        raise ValueError("a critical value goes with cluster correction")
    keys = [*t.search, *(["t_test"] if spec.generalize else [])]
    if classes is None and not spec.regression:
        classes = int(t.df.agg(F.max(t.label)).first()[0] or 0)
    real = written(_run(t, spec, classes).select(*keys, F.col("perf").alias("stat")))
    null = written(_run(permuted(t, n_permutations, seed), replace(spec, within=("perm",)), classes).select("perm", *keys, F.col("perf").alias("stat")))
    if correct != "cluster":
        cells = real.count() if correct == "bonferroni" else 1
        return stats.permutation_p(real, null, keys, n_permutations, tail, alpha, cells), null
    shape = [int(v) + 1 for v in real.agg(*[F.max(k) for k in keys]).first()]
    long = lambda df: df.select(F.col("perm").cast("bigint").alias("perm"), *[F.col(k).cast("bigint").alias(k) for k in keys], "stat")
    clusters = lambda df: stats.clusters_nd(long(df), keys, shape, critical, ("perm",), tail, full)
    found = clusters(real.withColumn("perm", F.lit(0)))
    p = stats.cluster_p(found.select("cluster_id", "size", "mass").distinct(), clusters(null), n_permutations, statistic, tail).select("cluster_id", "p")
    masked = found.drop("perm").join(p, "cluster_id").withColumn("mask", F.col("p") < alpha)
    return long(real.withColumn("perm", F.lit(0))).drop("perm").join(masked, keys, "left").withColumn("mask", F.coalesce("mask", F.lit(False))), null


def binomial_test(t: TensorFrame, spec: AnalysisSpec, chance: float | None = None, alpha: float = 0.05, classes: int | None = None) -> DataFrame:
    """(positions, p, mask) of accuracies against chance: P(K > floor(accuracy * samples))."""
    if tuple(spec.metric) not in (("accuracy",), ("acc",)):
        raise ValueError("the binomial test takes accuracy")
    classes = classes or int(t.df.agg(F.max(t.label)).first()[0] or 0)
    keys = [*t.search, *(["t_test"] if spec.generalize else [])]
    n = t.df.select("sample_id").distinct().count()
    perf = classify(t, spec, classes).select(*keys, "perf", F.lit(n).alias("n"))
    return stats.binomial(perf, keys, chance or 1 / classes, alpha)


def group_test(
    df: DataFrame, keys: Sequence[str], unit: str = "subject", x: str = "perf", design: str = "within", statistic: str = "ttest", null: float = 0.0,
    group: str = "grp", n_permutations: int = 1000, tail: int = 1, alpha: float = 0.05, bonferroni: int = 1, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(keys, stat, p, mask; null distribution) over subjects, one row of ``df`` for each subject and key.

    ``within``: values less ``null`` (subtract conditions first), signs flipped by subject. ``between``: ``group`` 1 and 2,
    group labels permuted over subjects with the sizes kept. ``statistic``: mean, ttest or wilcoxon (its signed z).
    """
    if design not in ("within", "between") or statistic not in ("mean", "ttest", "wilcoxon"):
        raise ValueError("design within or between; statistic mean, ttest or wilcoxon")
    keys = list(keys)
    if design == "within":
        base = df.select(*keys, unit, (F.col(x) - null).alias("x"))

        def of(d: DataFrame, by: list[str], value: Column) -> DataFrame:
            if statistic == "ttest":
                return stats.t_statistic(d, by, value)
            if statistic == "mean":
                return d.groupBy(*by).agg(F.avg(value).alias("stat"))
            return stats.signed_rank(d.withColumn("x", value), by).select(*by, F.col("z").alias("stat"))

        real = of(base, keys, F.col("x"))
        spread = of(stats.sign_flips(base.withColumn("_u", F.xxhash64(unit, F.lit(seed)) % 1_000_003), "_u", n_permutations), [*keys, "perm"], F.col("x") * F.col("sign"))
    else:
        base = df.select(*keys, unit, F.col(x).alias("x"), F.col(group).cast("int").alias("grp"))

        def between(d: DataFrame, by: list[str]) -> DataFrame:
            if statistic == "ttest":
                return stats.two_sample_t(d, by)
            if statistic == "mean":
                return d.groupBy(*by).agg((F.avg(F.when(F.col("grp") == 1, F.col("x"))) - F.avg(F.when(F.col("grp") != 1, F.col("x")))).alias("stat"))
            return stats.rank_sum(d, by, signed=True).select(*by, F.col("z").alias("stat"))

        units = base.select(unit, "grp").distinct()
        first = units.agg(F.count(F.when(F.col("grp") == 1, 1)).alias("n")).first()["n"]
        order = Window.partitionBy("perm").orderBy(F.xxhash64(unit, "perm", F.lit(seed)), unit)
        drawn = units.select(unit).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))))
        drawn = drawn.withColumn("grp", F.when(F.row_number().over(order) <= first, 1).otherwise(2))
        real, spread = between(base, keys), between(base.drop("grp").join(drawn, unit), [*keys, "perm"])
    return stats.permutation_p(real, spread, keys, n_permutations, tail, alpha, bonferroni), spread
