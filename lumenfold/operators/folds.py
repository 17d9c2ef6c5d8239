"""Cross-validation folds as a table (repeat, fold, sample_id): ``fold`` is the one that tests the sample.

Deterministic order comes from an integer congruence both engines can evaluate; ``random=True`` draws with ``rand``
instead. Ranks are taken within strata that are spread over ``repeat``, never over the whole table in one task, unless
a scheme is defined by a global order (leave-one-out numbers samples with range partitions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lcg(ident: Column, seed: Column | int = 0) -> Column:
    return (ident.cast("bigint") * 1103515245 + 12345 + F.lit(seed) * 7919) % 2147483648


def _keyed(samples: DataFrame, repeats: int, random: bool) -> DataFrame:
    df = samples.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return df.withColumn("key", F.rand(7) if random else lcg(F.col("sample_id"), F.col("repeat")))


def kfold(samples: DataFrame, k: int = 5, repeats: int = 1, stratify: bool = True, random: bool = False, within: Sequence[str] = ()) -> DataFrame:
    part = ["repeat", *within, "clabel"] if stratify else ["repeat", *within]
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("key", "sample_id"))
    return _keyed(samples, repeats, random).select("repeat", (F.pmod(rank - 1, F.lit(k)) + 1).cast("int").alias("fold"), "sample_id")


def holdout(samples: DataFrame, p: float = 0.1, repeats: int = 1, stratify: bool = True, random: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """fold 1 tests round(p * n) samples (of each class); the others are trained on and have fold 0."""
    part = ["repeat", *within, "clabel"] if stratify else ["repeat", *within]
    w = Window.partitionBy(*part)
    rank, n = F.row_number().over(w.orderBy("key", "sample_id")), F.count(F.lit(1)).over(w)
    return _keyed(samples, repeats, random).select("repeat", F.when(rank <= F.round(n * F.lit(p)), 1).otherwise(0).cast("int").alias("fold"), "sample_id")


def dense_number(df: DataFrame, *order: str) -> DataFrame:
    """Consecutive numbers ``rn`` in a global order without one task for all rows: range partitions, offsets by partition."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    parts = parts.withColumn("in_part", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = parts.groupBy("part").agg(F.max("in_part").alias("m"))
    before = sizes.withColumn("off", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    return parts.join(F.broadcast(before.select("part", "off")), "part").withColumn("rn", F.col("in_part") + F.col("off")).drop("part", "in_part", "off")


def leaveout(samples: DataFrame) -> DataFrame:
    return dense_number(samples.select("sample_id"), "sample_id").select(F.lit(1).alias("repeat"), F.col("rn").cast("int").alias("fold"), "sample_id")


def leaveout_grouped(samples: DataFrame, group_size: int = 5, random: bool = False) -> DataFrame:
    """Leave one averaged group out: groups within classes; leftovers have fold 0 and always train."""
    df = _keyed(samples, 1, random)
    w = Window.partitionBy("clabel")
    df = df.withColumn("g", F.floor((F.row_number().over(w.orderBy("key", "sample_id")) - 1) / group_size)).withColumn("full", F.floor(F.count(F.lit(1)).over(w) / group_size))
    sizes = samples.groupBy("clabel").agg(F.floor(F.count(F.lit(1)) / group_size).alias("m"))
    off = sizes.withColumn("off", F.coalesce(F.sum("m").over(Window.orderBy("clabel").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")  # one row per class
    return df.join(F.broadcast(off), "clabel").select(F.lit(1).alias("repeat"), F.when(F.col("g") < F.col("full"), F.col("g") + F.col("off") + 1).otherwise(0).cast("int").alias("fold"), "sample_id")


def predefined(samples: DataFrame, fold: str = "fold") -> DataFrame:
    """A column of the samples; folds are its distinct values."""
    return samples.select(F.lit(1).alias("repeat"), F.col(fold).cast("int").alias("fold"), "sample_id")


def none(samples: DataFrame) -> DataFrame:
    """No split: everything is trained on and tested."""
    return samples.select(F.lit(1).alias("repeat"), F.lit(1).alias("fold"), "sample_id")


def split(data: DataFrame, folds: DataFrame) -> DataFrame:
    """Every (repeat, fold) with its training and test rows: column ``is_test``. Rows are copied once per fold.

    No fold is left out; the join with the fold numbers is on ``repeat`` and its strategy is left to the planner.
    """
    numbers = folds.where("fold > 0").select("repeat", F.col("fold").alias("cv_fold")).distinct()
    return data.join(folds, "sample_id").join(numbers, "repeat").withColumn("is_test", F.col("fold") == F.col("cv_fold")).drop("fold").withColumnRenamed("cv_fold", "fold")
