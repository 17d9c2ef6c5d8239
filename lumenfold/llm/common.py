"""Helpers shared by the corpus operators: scratch tables, ids and word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_SCRATCH: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """Table ``table`` of ``sf_dir``, cut to ``cols`` so that only they reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); one is made only for a session of one machine that names none."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="lumenfold-")  # one machine, as in tests
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/lumenfold-{label}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_drop_all)
    _SCRATCH.append((spark, path))
    return path


def save(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cut the lineage of ``df``: write it to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for spark, path in _SCRATCH:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            return


def with_row_ids(docs: DataFrame, col: str) -> DataFrame:
    """``docs`` plus ``col``: ``doc_id``, or a number above all ids where that does not tell different texts apart.

    Rows without an id, and rows that share one with other texts, get numbers; rows equal in id and text have the same.
    """
    as_long = F.col("doc_id").cast("bigint")
    ids = docs.select(as_long.alias("doc_id"))
    repeated, _ = save(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return docs.withColumn(col, as_long)
    key = F.sha2(F.concat(F.lit("t"), F.col("text")), 256)  # null for a null text
    rows = docs.select(as_long.alias("doc_id"), F.coalesce(key, F.lit("")).alias("key"))
    rows, _ = save(rows.join(repeated, rows["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi").distinct(), "repeated-rows")
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id")
    numbered = rows.join(several, rows["doc_id"].eqNullSafe(several["doc_id"]), "left_semi").withColumn("number", F.monotonically_increasing_id())
    numbered, _ = save(numbered, "row-ids")
    above = (ids.agg(F.max("doc_id").alias("top")).first()["top"] or 0) + 1
    named = numbered.select(F.col("doc_id").alias("_lumenfold_id"), F.col("key").alias("_lumenfold_key"), (F.col("number") + above).alias("_lumenfold_number"))
    got = docs.join(named, as_long.eqNullSafe(F.col("_lumenfold_id")) & (F.coalesce(key, F.lit("")) == F.col("_lumenfold_key")), "left")
    return got.withColumn(col, F.coalesce("_lumenfold_number", as_long)).drop("_lumenfold_id", "_lumenfold_key", "_lumenfold_number")


def word_hash(words: Iterable[bytes], cache: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words, looked up in ``cache`` (a ``HashCache``)."""
    return np.fromiter(map(cache.__getitem__, words), np.uint64)


class HashCache(dict):
    """word -> xxh64, forgotten as a whole at ``limit`` entries so that memory stays bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, chars: int = 2_000_000, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a record batch into pieces of about ``chars`` characters (one row at least)."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(arrays: Iterator[pa.Array], chars: int = 2_000_000) -> Iterator[tuple[pa.Array, Iterator[list[str | None]]]]:
    """Each Arrow array with its texts as lists of about ``chars`` characters (one row at least), so that few are Python objects at once."""
    for array in arrays:
        batch = pa.RecordBatch.from_arrays([array], names=["text"])
        yield array, (part.column("text").to_pylist() for part in slices(batch, chars))


def in_crc_fold(doc_id: Column, parts: int, rest: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``, equals ``rest``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == rest
