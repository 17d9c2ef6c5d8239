"""Scatter matrices, shrinkage and small closed-form models as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tensors import TensorFrame


def class_means(t: TensorFrame, keys: Sequence[str] = ()) -> DataFrame:
    return t.long().groupBy(*keys, *t.search, "clabel", "f").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))


def pairs_of_features(t: TensorFrame) -> DataFrame:
    """(sample_id, search, clabel, fi, fj, xi, xj) with fi <= fj, expanded in the row: no join of samples with themselves."""
    base = t.df.select("sample_id", *t.search, "clabel", F.posexplode("features").alias("fi", "xi"), F.col("features").alias("v"))
    return base.select("sample_id", *t.search, "clabel", "fi", "xi", F.posexplode("v").alias("fj", "xj")).where("fi <= fj")


def class_scatter(t: TensorFrame) -> DataFrame:
    """Population covariance times n of each class: (search, clabel, fi, fj, scatter)."""
    return pairs_of_features(t).groupBy(*t.search, "clabel", "fi", "fj").agg((F.covar_pop("xi", "xj") * F.count(F.lit(1))).alias("scatter"), F.count(F.lit(1)).alias("n"))


def ledoit_wolf(t: TensorFrame) -> DataFrame:
    """Shrinkage towards the scaled identity, of data centred by feature: (search, lambda)."""
    mean = t.long().groupBy(*t.search, "f").agg(F.avg("x").alias("m"))
    packed = mean.groupBy(*t.search).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda p: p["m"]).alias("mu"))
    joined = t.df.join(F.broadcast(packed), list(t.search)) if t.search else t.df.crossJoin(F.broadcast(packed))
    centred = TensorFrame(joined.withColumn("features", F.zip_with("features", "mu", lambda a, b: a - b)).drop("mu"), t.search, t.label)
    p = pairs_of_features(centred).withColumn("q", F.col("xi") * F.col("xj"))
    cell = p.groupBy(*t.search, "fi", "fj").agg(F.avg("q").alias("s"), F.avg(F.col("q") * F.col("q")).alias("s2"), F.count(F.lit(1)).alias("n"))
    twice = F.when(F.col("fi") == F.col("fj"), 1.0).otherwise(2.0)
    a = cell.groupBy(*t.search).agg(
        F.sum(twice * (F.col("s2") - F.col("s") * F.col("s"))).alias("phi"), F.sum(twice * F.col("s") * F.col("s")).alias("ss"),
        F.sum(F.when(F.col("fi") == F.col("fj"), F.col("s")).otherwise(0.0)).alias("tr"), F.count_if(F.col("fi") == F.col("fj")).alias("p"), F.max("n").alias("n"),
    )
    gamma = F.col("ss") - F.col("tr") * F.col("tr") / F.col("p")
    return a.select(*t.search, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(gamma > 0, F.col("phi") / gamma / F.col("n")).otherwise(F.lit(1.0)))).alias("lambda"))


def activation_pattern(t: TensorFrame, weights: list[float]) -> DataFrame:
    """Pooled within-class population covariance times the weights: (search, f, pattern)."""
    s = class_scatter(t).groupBy(*t.search, "fi", "fj").agg((F.sum("scatter") / F.sum("n")).alias("c"))
    full = s.select(*t.search, F.col("fi").alias("f"), F.col("fj").alias("g"), "c").union(s.where("fi < fj").select(*t.search, F.col("fj").alias("f"), F.col("fi").alias("g"), "c"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    return full.groupBy(*t.search, "f").agg(F.sum(F.col("c") * F.element_at(w, F.col("g") + 1)).alias("pattern"))


def lda_two_features(df: DataFrame, keys: Sequence[str] = (), ridge: float = 0.0) -> DataFrame:
    """Two-class discriminant of columns x1, x2 (clabel 1, 2) in closed form: w1, w2, b."""
    c = df.groupBy(*keys, "clabel").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.covar_pop("x1", "x1").alias("s11"), F.covar_pop("x1", "x2").alias("s12"), F.covar_pop("x2", "x2").alias("s22"),
    )
    of = lambda n, k: F.max(F.when(F.col("clabel") == k, F.col(n)))
    a = c.groupBy(*keys).agg(
        *[F.sum(F.col("n") * F.col(s)).alias(s) for s in ("s11", "s12", "s22")], *[of(m, k).alias(f"{m}{k}") for m in ("m1", "m2") for k in (1, 2)]
    )
    a = a.withColumn("s11", F.col("s11") + ridge).withColumn("s22", F.col("s22") + ridge)
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    d1, d2 = F.col("m11") - F.col("m12"), F.col("m21") - F.col("m22")
    a = a.withColumn("w1", (F.col("s22") * d1 - F.col("s12") * d2) / det).withColumn("w2", (F.col("s11") * d2 - F.col("s12") * d1) / det)
    return a.select(*keys, "w1", "w2", (-(F.col("w1") * (F.col("m11") + F.col("m12")) + F.col("w2") * (F.col("m21") + F.col("m22"))) / 2).alias("b"))


def ridge_one_feature(df: DataFrame, keys: Sequence[str] = (), lam: float = 1.0) -> DataFrame:
    """Ridge of y on x in closed form: w, b."""
    a = df.groupBy(*keys).agg(F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    a = a.withColumn("w", F.col("cxy") * F.col("n") / (F.col("vx") * F.col("n") + lam))
    return a.select(*keys, "w", (F.col("my") - F.col("w") * F.col("mx")).alias("b"))


def pca_two_features(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Eigenvalues of the covariance of x1, x2, largest first."""
    a = df.groupBy(*keys).agg(F.var_samp("x1").alias("a"), F.covar_samp("x1", "x2").alias("b"), F.var_samp("x2").alias("d"))
    root = F.sqrt((F.col("a") - F.col("d")) * (F.col("a") - F.col("d")) / 4 + F.col("b") * F.col("b"))
    mid = (F.col("a") + F.col("d")) / 2
    return a.select(*keys, (mid + root).alias("e1"), (mid - root).alias("e2"))
