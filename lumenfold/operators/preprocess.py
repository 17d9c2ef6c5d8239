"""Preprocessing as DataFrame stages: parameters come from training rows only and are applied to both sides.

Stages take long or scalar rows with a boolean ``is_test`` and grouping keys (repeat, fold, search dimensions, feature).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import lcg

STAGES: dict[str, Callable[..., DataFrame]] = {}


def register_stage(name: str, stage: Callable[..., DataFrame]) -> None:
    """Make a user's stage known by name: ``stage(df, keys, **params) -> DataFrame``."""
    STAGES[name] = stage


def _fitted(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    params = df.where("NOT is_test").groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(params, list(keys))


def demean(df: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    return _fitted(df, keys, _m=F.avg(x)).withColumn(x, F.col(x) - F.col("_m")).drop("_m")


def zscore(df: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Training mean and deviation (n - 1); a deviation of 0 gives NaN."""
    z = F.when(F.col("_s") != 0, (F.col(x) - F.col("_m")) / F.col("_s")).otherwise(F.lit(float("nan")))
    return _fitted(df, keys, _m=F.avg(x), _s=F.stddev_samp(x)).withColumn(x, z).drop("_m", "_s")


def normalise(df: DataFrame, keys: Sequence[str], method: str = "zscore", x: str = "x") -> DataFrame:
    """The same without a split: all rows are training rows."""
    stage = {"zscore": zscore, "demean": demean}[method]
    return stage(df.withColumn("is_test", F.lit(False)), keys, x).drop("is_test")


def groups_of(df: DataFrame, keys: Sequence[str], size: int, ident: str = "sample_id", seed: int = 0) -> DataFrame:
    """Column ``grp``: shuffled groups of ``size`` samples within keys and class; leftovers are dropped."""
    w = Window.partitionBy(*keys, "clabel")
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(lcg(F.col(ident), seed), ident)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.withColumn("grp", F.floor(F.col("_r") / size)).where(F.col("grp") < F.floor(F.col("_n") / size)).drop("_r", "_n")


def average_samples(df: DataFrame, keys: Sequence[str], size: int = 5, x: str = "x", seed: int = 0) -> DataFrame:
    """Means of groups of samples of one class, for training and test rows apart if ``is_test`` is a key."""
    return groups_of(df, keys, size, seed=seed).groupBy(*keys, "clabel", "grp").agg(F.avg(x).alias(x), F.count(F.lit(1)).alias("n"))


def average_kernel(pairs: DataFrame, membership: DataFrame, search: Sequence[str] = ()) -> DataFrame:
    """Kernel pairs (i, j, k) averaged over groups of samples on both axes: two joins with (sample_id, grp)."""
    a = membership.select(F.col("sample_id").alias("i"), F.col("grp").alias("gi"))
    b = membership.select(F.col("sample_id").alias("j"), F.col("grp").alias("gj"))
    return pairs.join(a, "i").join(b, "j").groupBy(*search, "gi", "gj").agg(F.avg("k").alias("k"))


def _class_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = df.groupBy(*keys, "clabel").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    return n.withColumn("_most", F.max("_n").over(w)).withColumn("_least", F.min("_n").over(w))  # one row per class and key


def undersample(df: DataFrame, keys: Sequence[str], ident: str = "sample_id", seed: int = 0) -> DataFrame:
    """Each class cut to the smallest one."""
    w = Window.partitionBy(*keys, "clabel").orderBy(lcg(F.col(ident), seed), ident)
    ranked = df.withColumn("_r", F.row_number().over(w)).join(F.broadcast(_class_sizes(df, keys)), [*keys, "clabel"])
    return ranked.where("_r <= _least").drop("_r", "_n", "_most", "_least")


def oversample(df: DataFrame, keys: Sequence[str], ident: str = "sample_id", seed: int = 0, replace: bool = True) -> DataFrame:
    """Each class brought to the largest one: draws with replacement by a congruence of the draw number, or whole rounds."""
    w = Window.partitionBy(*keys, "clabel").orderBy(lcg(F.col(ident), seed), ident)
    sizes = _class_sizes(df, keys)
    ranked = df.withColumn("_r", (F.row_number().over(w) - 1).cast("bigint"))
    extra = sizes.where("_most > _n").select(*keys, "clabel", "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_most") - F.col("_n"))).alias("_d"))
    pick = lcg(F.col("_d"), seed) % F.col("_n") if replace else (F.col("_d") - 1) % F.col("_n")
    drawn = extra.withColumn("_r", pick).select(*keys, "clabel", "_r").join(ranked, [*keys, "clabel", "_r"])
    cols = df.columns
    return df.select(*cols).unionByName(drawn.select(*cols))


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def impute(df: DataFrame, keys: Sequence[str], along: str, method: str = "forward", x: str = "x", fill: float | None = None, seed: int = 0) -> DataFrame:
    """forward, backward, nearest (of the two, the earlier among equals), random (a complete slice's value) or fill.

    Windows are per key, i.e. per series; what no neighbour fills stays NaN unless ``fill`` is given.
    """
    v = F.when(missing(F.col(x)), F.lit(None).cast("double")).otherwise(F.col(x))
    if method in ("forward", "backward", "nearest"):
        w = Window.partitionBy(*keys).orderBy(along)
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        at = F.when(v.isNotNull(), F.col(along))
        prev, nxt = F.last(v, True).over(back), F.first(v, True).over(ahead)
        if method == "nearest":
            near = F.col(along) - F.last(at, True).over(back) <= F.first(at, True).over(ahead) - F.col(along)
            new = F.when(near | nxt.isNull(), prev).otherwise(nxt)
        else:
            new = prev if method == "forward" else nxt
        df = df.withColumn(x, new)
    elif method == "random":
        slices = df.groupBy(along).agg(F.max(missing(F.col(x)).cast("int")).alias("bad"))
        donors = slices.where("bad = 0").select(along)
        dn = donors.agg(F.array_sort(F.collect_list(along)).alias("donors"))  # slice numbers only
        df = df.join(F.broadcast(slices), along).crossJoin(F.broadcast(dn))
        pick = F.when(F.size("donors") > 0, F.element_at("donors", (lcg(F.col(along), seed) % F.greatest(F.size("donors"), F.lit(1)) + 1).cast("int")))
        source = df.select(*keys, F.col(along).alias("_from"), F.col(x).alias("_given"))
        df = df.withColumn("_from", F.when(missing(F.col(x)), pick)).join(source, [*keys, "_from"], "left").withColumn(x, F.when(missing(F.col(x)), F.col("_given")).otherwise(F.col(x))).drop("bad", "donors", "_from", "_given")
    else:
        df = df.withColumn(x, v)
    return df.withColumn(x, F.coalesce(F.col(x), F.lit(float("nan") if fill is None else float(fill))))


for _name, _stage in (("demean", demean), ("zscore", zscore), ("average_samples", average_samples), ("undersample", undersample), ("oversample", oversample), ("impute_nan", impute)):
    register_stage(_name, _stage)
