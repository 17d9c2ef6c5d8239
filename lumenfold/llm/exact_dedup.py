"""Exact dedup by a persistent digest index.

The index is a table bucketed and sorted by digest, one row for each distinct
normalised text. New data is reduced to one row per digest (partial aggregation
before the shuffle, so a hot text costs one row per task), deduplicated against
the index by a sort-merge anti-join without moving the index, and appended. What
a call returns is read from the index by a join in the same buckets.

Within a call the largest ``doc_id`` of equal texts stays. The rows are dealt
into ``batches`` by descending ranges of ``doc_id`` and ingested one after the
other, so that a text the index holds already keeps the larger id and each batch
after the first goes through anti-join and append. Against an index of earlier
calls, a text that it holds keeps its indexed id, whether that is larger or not;
``group_size`` counts the rows of the call with that text.

Normalisation lower-cases A-Z only. Null texts count as empty; all empty texts
are equal. Rows whose ``doc_id`` is null are grouped like others, in the last
batch; they stay only if no row with an id has the same text. Rows that repeat
the id that stays, with the same text, are one document and all kept. An empty
table gives an empty result. Extra columns are ignored by the index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_path, save, scratch_path


def digest_of(text: str = "text") -> Column:
    """SHA-256 of a normalised whole text."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest binary) of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest_of().alias("digest"))


class DigestIndex:
    """Digest index kept as a bucketed table below ``path`` (a folder all executors share).

    The number of buckets is part of the folder's name: an index is always reopened with the number it was made with.
    Asking for another one is an error.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "digests")
        found = self._made_with()
        if found and buckets and found != buckets:
            raise ValueError(f"the index at {self.path} has {found} buckets, not {buckets}")
        self.buckets = found or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.data = f"{self.path}/buckets-{self.buckets}"
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.data).hex}"

    def _made_with(self) -> int | None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(target):
            return None
        names = [f.getPath().getName() for f in files.listStatus(target)]
        return next((int(n.removeprefix("buckets-")) for n in names if n.startswith("buckets-")), None)

    def exists(self) -> bool:
        """Whether the index holds a batch; an index written by an earlier session is found by its path."""
        if self.spark.catalog.tableExists(self.table):
            return True
        if not self._made_with():
            return False
        self.spark.sql(
            f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.data}'"
        )
        return True

    def ingest(self, digested: DataFrame) -> None:
        """Append the digests of a batch that the index does not hold yet."""
        new = digested.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        held = self.exists()
        if held:
            new = new.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (new.write.mode("append" if held else "errorifexists").format("parquet").option("path", self.data)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def rows(self) -> DataFrame:
        """(digest, keep_id), read in buckets."""
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_path(self.spark, self.path)


def _ranges(digested: DataFrame, batches: int) -> list[DataFrame]:
    """The rows by descending ranges of doc_id; null ids are in the last one."""
    ends = digested.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if ends["lo"] is None or batches < 2:
        return [digested]
    cuts = sorted({ends["lo"] + (ends["hi"] - ends["lo"]) * k // batches for k in range(1, batches)}, reverse=True)
    above = [None, *cuts]
    return [digested.where((F.lit(True) if top is None else F.col("doc_id") <= top) & (F.col("doc_id") > low)) for top, low in zip(above, cuts)] + [
        digested.where(F.col("doc_id").isNull() | (F.col("doc_id") <= cuts[-1]))
    ]


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With ``index`` the rows are deduplicated against what it holds and added to it; without, it lives for the call.
    """
    spark = docs.sparkSession
    digested, _ = save(digests(docs.select("doc_id", "text")), "digested")
    own = index or DigestIndex(spark)
    for part in _ranges(digested, batches):
        own.ingest(part)
    # the index stays in its buckets, the call's digests come to it; written, so that a hot text's rows can be split below
    sizes = digested.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups, _ = save(own.rows().hint("merge").join(sizes, "digest").select("digest", "keep_id", "group_size"), "digest-groups")
    if index is None:
        own.drop()
    return digested.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The whole rows of ``docs`` that stay: of equal texts those with the id that stays."""
    cols, own, digest = docs.columns, "_lumenfold_id", "_lumenfold_digest"
    stay = exact_dedup(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias(own), F.unhex("text_sha256").alias(digest)).distinct()
    # id and digest deal the rows together, so that rows of a hot text do not meet
    marked = docs.select(*cols, digest_of().alias("_lumenfold_of_text"))
    return marked.join(stay, (F.col("_lumenfold_of_text") == F.col(digest)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(own))).select(*cols)
