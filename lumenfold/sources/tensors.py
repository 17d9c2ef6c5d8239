"""Tensor frames: samples x search dimensions x features as DataFrames with named columns.

Packed form: ``sample_id``, one integer column per search dimension, ``features ARRAY<DOUBLE>`` and labels.
Long form: the same keys with ``f INT, x DOUBLE``. Missing values are NaN, never NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TensorFrame:
    """A packed tensor; ``search`` names its search dimensions, ``label`` its class or response column."""

    df: DataFrame
    search: tuple[str, ...] = ()
    label: str = "clabel"

    @property
    def keys(self) -> list[str]:
        return ["sample_id", *self.search]

    def long(self) -> DataFrame:
        keep = [c for c in self.df.columns if c != "features"]
        return self.df.select(*keep, F.posexplode("features").alias("f", "x"))

    def where(self, condition: Column | str) -> TensorFrame:
        return replace(self, df=self.df.where(condition))

    def flatten(self, *dims: str) -> TensorFrame:
        """Search dimensions into features, column-major: the first feature dimension runs fastest."""
        rest = tuple(s for s in self.search if s not in dims)
        keys = ["sample_id", *rest, *[c for c in self.df.columns if c == self.label]]
        order = F.struct(*[F.col(d) for d in reversed(dims)], F.col("features").alias("v"))
        packed = self.df.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("parts"))
        return replace(self, df=packed.select(*keys, F.flatten(F.transform("parts", lambda p: p["v"])).alias("features")), search=rest)

    def relabelled(self) -> TensorFrame:
        """Labels to 1..C in sorted order. The label table has one row per class."""
        return replace(self, df=relabel(self.df, self.label))


def relabel(df: DataFrame, label: str = "clabel", max_classes: int = 10_000) -> DataFrame:
    """Replace ``label`` by its rank among the distinct labels (1..C)."""
    found = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(max_classes + 1).collect()]
    if len(found) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    table = F.create_map(*[F.lit(x) for i, v in enumerate(found) for x in (v, i + 1)]) if found else None
    return df.withColumn(label, table[F.col(label)].cast("int") if table is not None else F.lit(None).cast("int"))


def pack(long: DataFrame, keys: list[str], f: str = "f", x: str = "x") -> DataFrame:
    """Long form to arrays in feature order."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(f, x))), lambda p: p[x]).alias("features"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings_tensor(spark: SparkSession, sf_dir: str, width: int = 8) -> TensorFrame:
    """64 values as ``width`` features at 64 / width times; five predefined folds."""
    e = table(spark, sf_dir, "embeddings")
    times = F.transform(F.sequence(F.lit(0), F.lit(64 // width - 1)), lambda t: F.transform(F.slice("embedding", t * width + 1, width), lambda v: v.cast("double")))
    return TensorFrame(
        e.select(F.col("vec_id").alias("sample_id"), (F.col("label") + 1).cast("int").alias("clabel"), (F.col("vec_id") % 5 + 1).cast("int").alias("fold"), F.posexplode(times).alias("t", "features")),
        ("t",),
    )


def flat_embeddings(spark: SparkSession, sf_dir: str) -> TensorFrame:
    e = table(spark, sf_dir, "embeddings")
    return TensorFrame(e.select(F.col("vec_id").alias("sample_id"), (F.col("label") + 1).cast("int").alias("clabel"), (F.col("vec_id") % 5 + 1).cast("int").alias("fold"), F.transform("embedding", lambda v: v.cast("double")).alias("features")))


def zscore_global(t: TensorFrame) -> TensorFrame:
    """Loader option: one mean and deviation over all cells."""
    s = t.long().agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    return replace(t, df=t.df.crossJoin(F.broadcast(s)).withColumn("features", F.transform("features", lambda v: (v - F.col("m")) / F.col("s"))).drop("m", "s"))


def write(t: TensorFrame, path: str, mode: str = "errorifexists") -> None:
    """Sink: partitioned by nothing, sorted within files by the search dimensions so that row groups prune on them."""
    (t.df.sortWithinPartitions(*t.search) if t.search else t.df).write.mode(mode).parquet(path)
