"""Gaussian naive Bayes as a relational plan.

Count, mean and squared deviations of each (fold, search, class, feature) cell are taken in one scan; the training
statistics of a fold are the total less the fold, in deviations from the total's mean, so that large values lose no
digits. Models are packed to one row per (fold, search): scoring is a join with that table and an in-row search over
classes; the planner broadcasts it where its size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tensors import TensorFrame


def cell_moments(t: TensorFrame, *extra: str) -> DataFrame:
    """(extra..., search..., clabel, f): n, mean m and sum q of squared deviations from it, one row for each cell."""
    cells = t.long().groupBy(*extra, *t.search, "clabel", "f").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return cells.withColumn("q", F.col("v") * F.col("n")).drop("v")


def _totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of all cells of ``keys`` together: (keys, n_all, m_all, q_all)."""
    centre = cells.groupBy(*keys).agg(F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m_all"))
    shift = F.col("m") - F.col("m_all")
    return cells.join(centre, keys).groupBy(*keys, "n_all", "m_all").agg(F.sum(F.col("q") + F.col("n") * shift * shift).alias("q_all"))


def fit_folds(t: TensorFrame, fold: str = "fold") -> DataFrame:
    """(fold, search..., classes ARRAY<STRUCT<c, n, mu, va>>): models trained on all other folds, totals less the fold."""
    keys = [*t.search, "clabel", "f"]
    cells = cell_moments(t, fold)
    folds = cells.select(fold).distinct()  # a row for each fold; the product below is the table of models itself
    rows = _totals(cells, keys).crossJoin(F.broadcast(folds)).join(cells, [*keys, fold], "left")
    n, shift = F.coalesce("n", F.lit(0)), F.coalesce(F.col("m") - F.col("m_all"), F.lit(0.0))
    left = F.col("n_all") - n
    move = -n * shift / left
    rest = rows.where(left > 0).select(fold, *keys, left.alias("n"), (F.col("m_all") + move).alias("m"), (F.col("q_all") - F.coalesce("q", F.lit(0.0)) - n * shift * shift - left * move * move).alias("q"))
    return _pack(rest, [fold, *t.search])


def fit_all(t: TensorFrame) -> DataFrame:
    """(search..., classes): models trained on all samples."""
    return _pack(cell_moments(t), list(t.search))


def _pack(cells: DataFrame, keys: list[str]) -> DataFrame:
    va = F.when(F.col("n") > 1, F.greatest(F.col("q"), F.lit(0.0)) / (F.col("n") - 1)).otherwise(F.lit(float("nan")))
    per_class = cells.groupBy(*keys, "clabel").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", F.col("m").alias("mu"), va.alias("va")))).alias("p"))
    c = F.struct(F.col("clabel").alias("c"), F.col("n"), F.transform("p", lambda q: q["mu"]).alias("mu"), F.transform("p", lambda q: q["va"]).alias("va"))
    return per_class.groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias("classes"))


def score(rows: DataFrame, models: DataFrame, on: list[str], prior: str = "equal") -> DataFrame:
    """``rows`` plus ``pred``: the class with the best score, the lowest among equals."""
    total = F.aggregate("classes", F.lit(0).cast("bigint"), lambda s, m: s + m["n"])

    def one(m):
        d = F.aggregate(
            F.arrays_zip(F.col("features").alias("x"), m["mu"].alias("m"), m["va"].alias("v")), F.lit(0.0),
            lambda s, z: s - (z["x"] - z["m"]) * (z["x"] - z["m"]) / (F.lit(2.0) * z["v"]),
        )
        return F.struct((d if prior == "equal" else d + F.log(m["n"] / total)).alias("s"), (-m["c"]).alias("c"))

    joined = rows.join(models, on)
    return joined.withColumn("pred", -F.array_max(F.transform("classes", one))["c"]).drop("classes")


def smooth_search(t: TensorFrame, edges: DataFrame, dim: str) -> TensorFrame:
    """Searchlight: the features of all neighbours of a position (edge table center, neighbour), in neighbour order."""
    rest = [c for c in t.df.columns if c not in (dim, "features")]
    joined = t.df.join(edges, t.df[dim] == edges["neighbour"])
    packed = joined.groupBy(*rest, F.col("center").alias(dim)).agg(F.array_sort(F.collect_list(F.struct("neighbour", "features"))).alias("p"))
    return TensorFrame(packed.select(*rest, dim, F.flatten(F.transform("p", lambda q: q["features"])).alias("features")), t.search, t.label)
