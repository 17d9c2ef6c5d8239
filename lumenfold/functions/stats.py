"""Significance tests over result tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import lcg


def normal_cdf(z: Column) -> Column:
    """Rational approximation of the normal distribution function (error under 7.5e-8); neither engine has erf."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def _stirling_rest(n: float) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    q = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * q)) / q) / q) / n


def _deviance(x: float, m: float) -> float:
    """x log(x / m) + m - x, without cancellation where x is near m."""
    if abs(x - m) >= 0.1 * (x + m):
        return x * math.log(x / m) + m - x
    v = (x - m) / (x + m)
    total, term, k = (x - m) * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        if total + term / k == total:
            return total
        total += term / k


def _mass(k: int, n: int, p: float) -> float:
    """P(K = k) in saddle-point form: exact to rounding for any n."""
    if k in (0, n):
        return math.exp(n * (math.log1p(-p) if k == 0 else math.log(p)))
    rest = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    return math.exp(rest) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz), for x under about a / (a + b)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    out, m = d, 0
    while True:
        m += 1
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + t * d) or 1e-300), (1 + t / c) or 1e-300
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            return out


def binomial_tail(hits: int, n: int, chance: float) -> float:
    """P(K > hits) of n trials: the incomplete beta function, in about sqrt(n) steps."""
    if hits >= n:
        return 0.0
    if hits < 0:
        return 1.0
    a, b = hits + 1, n - hits
    if chance < (a + 1) / (a + b + 2):
        return _mass(hits, n, chance) * chance * b / a * _fraction(a, b, chance)
    return 1 - _mass(hits, n, chance) * chance * _fraction(b, a, 1 - chance)


def binomial(df: DataFrame, keys: Sequence[str], chance: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """P(K > floor(perf * n)) from columns perf and n; mask where it is under alpha. One number per row, for any n."""
    tail = F.udf(lambda hits, n: binomial_tail(hits, n, chance), "double")
    rows = df.select(*keys, "n", F.floor(F.col("perf") * F.col("n") + 1e-9).alias("hits")).where("hits IS NOT NULL AND n IS NOT NULL")
    return rows.withColumn("p", tail("hits", "n")).select(*keys, "p", (F.col("p") < alpha).alias("mask"))


def _value_ranks(counts: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """``rank``: the midrank of each distinct value, from one row per value with its count ``n``."""
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("rank", below + (F.col("n") + 1) / F.lit(2.0))


def ranks(df: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """``rank``: ascending midranks within keys. Rows are counted by value first, so a window holds distinct values only."""
    found = _value_ranks(df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n")), keys, x).drop("n")
    return df.join(found, [*keys, x])


def rank_sum(df: DataFrame, keys: Sequence[str], x: str = "x", group: str = "grp", signed: bool = False) -> DataFrame:
    """Wilcoxon rank-sum: U (the smaller one), z without tie correction, two-tailed p. ``signed`` keeps the direction."""
    one = F.col(group) == 1
    values = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("bigint")).alias("c1"))
    a = _value_ranks(values, keys, x).groupBy(*keys).agg(F.sum(F.col("c1") * F.col("rank")).alias("r1"), F.sum("c1").alias("n1"), F.sum(F.col("n") - F.col("c1")).alias("n2"))
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)
    both = (F.col("n1") * F.col("n2")).cast("double")
    u = F.least(u1, both - u1)
    z = ((both / 2 - u) if not signed else (u1 - both / 2)) / F.sqrt(both * (F.col("n1") + F.col("n2") + 1) / 12)
    return a.select(*keys, u.alias("u"), z.alias("z")).withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))


def signed_rank(df: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Wilcoxon signed-rank of differences: zeros dropped, midranks of absolute values, p from abs(z)."""
    d = df.where((F.col(x) != 0) & ~F.isnan(x)).withColumn("_a", F.abs(x))
    values = d.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.signum(x)).alias("s"))
    a = _value_ranks(values, keys, "_a").groupBy(*keys).agg(F.sum(F.col("s") * F.col("rank")).alias("w"), F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    return a.select(*keys, "w", "n", (F.col("w") / F.sqrt(n * (n + 1) * (2 * n + 1) / 6)).alias("z")).withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))


def two_sample_t(df: DataFrame, keys: Sequence[str], x: str = "x", group: str = "grp") -> DataFrame:
    """Two-sample t with pooled variance of group 1 against the rest: (keys, stat)."""
    one = F.col(group) == 1
    side = lambda c, n: [F.avg(F.when(c, F.col(x))).alias(f"m{n}"), F.var_samp(F.when(c, F.col(x))).alias(f"v{n}"), F.count(F.when(c, F.col(x))).alias(f"n{n}")]
    a = df.groupBy(*keys).agg(*side(one, 1), *side(~one, 2))
    free = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.when(free > 0, free)
    error = F.sqrt(pooled * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    return a.select(*keys, F.when(error > 0, (F.col("m1") - F.col("m2")) / error).otherwise(F.lit(float("nan"))).alias("stat"))


def permutation_p(real: DataFrame, permuted: DataFrame, keys: Sequence[str], n_permutations: int, tail: int = 1, alpha: float = 0.05, bonferroni: int = 1) -> DataFrame:
    """p = share of permutations strictly beyond the real statistic (no + 1); alpha divided by ``bonferroni`` tests."""
    beyond = F.col("perm_stat") > F.col("stat") if tail == 1 else F.col("perm_stat") < F.col("stat")
    joined = real.select(*keys, "stat").join(permuted.select(*keys, F.col("stat").alias("perm_stat")), list(keys), "left") if keys else real.select("stat").crossJoin(F.broadcast(permuted.select(F.col("stat").alias("perm_stat"))))
    got = joined.groupBy(*keys).agg(F.first("stat").alias("stat"), (F.sum(F.coalesce(beyond, F.lit(False)).cast("int")) / F.lit(float(n_permutations))).alias("p"))
    return got.withColumn("mask", F.col("p") < alpha / bonferroni)


def sign_flips(df: DataFrame, unit: str, n_permutations: int) -> DataFrame:
    """Rows copied once per permutation with a sign for each unit: level-2 within-subject null."""
    perm = df.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))))
    bit = F.floor(lcg(F.col(unit) * 131 + F.col("perm") * 7919, 0) / 65536) % 2
    return perm.withColumn("sign", F.when(bit == 0, 1.0).otherwise(-1.0))


def t_statistic(df: DataFrame, keys: Sequence[str], x: Column) -> DataFrame:
    """One-sample t of ``x`` against 0."""
    a = df.groupBy(*keys).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(F.lit(1)).alias("n"))
    return a.select(*keys, F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).otherwise(F.lit(float("nan"))).alias("stat"))


def runs_1d(df: DataFrame, keys: Sequence[str], along: str, threshold: float, stat: str = "stat") -> DataFrame:
    """Clusters of consecutive positions above a threshold (gaps and islands): (keys, cluster_id, first, last, size, mass)."""
    w = Window.partitionBy(*keys).orderBy(along)
    up = df.where(F.col(stat) > threshold).withColumn("island", F.col(along) - F.row_number().over(w))
    c = up.groupBy(*keys, "island").agg(F.min(along).alias("first"), F.max(along).alias("last"), F.count(F.lit(1)).alias("size"), F.sum(stat).alias("mass"))
    return c.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).drop("island")


def label_components(mask: np.ndarray, full: bool = False) -> tuple[np.ndarray, int]:
    """Connected components of an N-D mask: neighbours share a face, or also edges and corners with ``full``."""
    out, n = np.zeros(mask.shape, int), 0
    steps = [s for s in np.ndindex(*(3,) * mask.ndim) if 0 < sum(abs(k - 1) for k in s) <= (mask.ndim if full else 1)]
    for seed in np.argwhere(mask):
        if out[tuple(seed)]:
            continue
        n += 1
        todo = [tuple(seed)]
        out[todo[0]] = n
        while todo:
            at = todo.pop()
            for s in steps:
                q = tuple(a + k - 1 for a, k in zip(at, s))
                if all(0 <= a < m for a, m in zip(q, mask.shape)) and mask[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out, n


def clusters_nd(df: DataFrame, dims: Sequence[str], shape: Sequence[int], threshold: float, keys: Sequence[str] = ("perm",), tail: int = 1, full: bool = False) -> DataFrame:
    """Clusters of an N-D result, one group per permutation: (keys, dims..., cluster_id, size, mass)."""
    import pandas as pd

    fields = ", ".join([*(f"{k} BIGINT" for k in keys), *(f"{d} BIGINT" for d in dims), "cluster_id BIGINT", "size BIGINT", "mass DOUBLE"])

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros(tuple(shape))
        at = tuple(part[d].to_numpy() for d in dims)
        grid[at] = part["stat"].to_numpy()
        mask = grid > threshold if tail == 1 else grid < threshold
        label, n = label_components(mask, full)
        size = np.bincount(label.ravel(), minlength=n + 1)
        mass = np.bincount(label.ravel(), grid.ravel(), n + 1)
        where = np.argwhere(label > 0)
        ids = label[label > 0]
        return pd.DataFrame({**{k: [v] * len(ids) for k, v in zip(keys, key)}, **{d: where[:, i] for i, d in enumerate(dims)}, "cluster_id": ids, "size": size[ids], "mass": mass[ids]})

    return df.select(*keys, *dims, "stat").groupBy(*keys).applyInPandas(run, fields)


def cluster_p(real: DataFrame, null: DataFrame, n_permutations: int, statistic: str = "mass", tail: int = 1) -> DataFrame:
    """p of each real cluster against the extreme cluster of each permutation (the smallest for tail -1)."""
    extreme = null.groupBy("perm").agg((F.max if tail == 1 else F.min)(statistic).alias("e")).agg(F.sort_array(F.collect_list("e")).alias("es"))  # a value per permutation
    beyond = F.size(F.filter("es", lambda v: v > F.col(statistic) if tail == 1 else v < F.col(statistic)))
    return real.crossJoin(F.broadcast(extreme)).withColumn("p", beyond / F.lit(float(n_permutations))).drop("es")
