"""Benchmark decontamination: MinHash containment search.

An item is found in a document when at least ``threshold`` of the item's
distinct five-word shingles occur in the document (words: runs of letters and
digits, lower-cased; 0.8 by default). Long documents make Jaccard similarity
useless for this, so the search is by containment:

1. Each item's MinHash sketch is its p smallest shingle hashes with
   p = q - ceil(threshold * q) + 1 of q shingles. A document that holds at least
   ceil(threshold * q) of them must hold one of those p (pigeonhole), so the
   search misses nothing.
2. Documents are partitioned by size, in powers of two of their number of
   shingles. A document can only hold items that need no more shingles than it
   has, so each partition searches the sketches of the items that fit into it,
   up to its own bound: the largest sketch hash among them. Hashes beyond the
   bound are dropped before the join; a document shorter than what every item
   needs is not searched.
3. Candidates are verified by exact shingle containment on strings.

The document side never shuffles its shingles while the items' shingles are
below ``broadcast_bytes`` (measured, not assumed); beyond it the join is by
shuffle, where AQE splits hot shingles. DataFrame functions only.

Null and empty texts, and items or documents of fewer than five words, have no
shingles and never match. Rows that repeat an item id with different texts are
matched one by one, and give a row for each text that is found; equal rows count
once. Rows that repeat a ``doc_id`` count as one document, which holds the
shingles of all of them; rows with a null id on either side are ignored. Empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

WORDS = 5
#: Size partitions: powers of two of a number of shingles.
PARTS = 40


def normalised(text: Column) -> Column:
    """Lower-cased words of letters and digits, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def shingles(text: Column, words: int = WORDS) -> Column:
    """Array of all overlapping ``words``-word strings of a normalised text."""
    ahead = " ".join(["[^ ]+"] * words)
    return F.regexp_extract_all(text, F.lit(f"(?=(?<![^ ])({ahead})(?![^ ]))[^ ]+"), F.lit(1))


def size_part(n: Column) -> Column:
    """Number of the partition of a size of 1 or more; never null, as a check for null would evaluate the text's words again."""
    return F.coalesce(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(0))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, words: int = WORDS, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) at or above ``threshold``."""
    texts = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", normalised(F.col("text")).alias("norm"))
    item_sh = (
        texts.select("item_id", F.sha1("norm").alias("item"), F.explode(shingles(F.col("norm"), words)).alias("shingle"))
        .distinct()
        .withColumn("h", F.xxhash64("shingle"))
    )
    item_sh, _ = save(item_sh, "item-shingles")
    q = item_sh.groupBy("item_id", "item").agg(
        F.count(F.lit(1)).alias("q"), F.array_sort(F.collect_list("h")).alias("hs"), F.sum(F.octet_length("shingle") + 64).alias("bytes")
    )
    sketch = (
        q.withColumn("need", F.ceil(F.lit(threshold) * F.col("q") - F.lit(1e-9)))
        .withColumn("sketch", F.slice("hs", F.lit(1), (F.col("q") - F.col("need") + 1).cast("int")))
        .select("item_id", "item", "q", "need", "sketch", "bytes", size_part(F.col("need")).alias("item_part"))
    )
    sketch, _ = save(sketch, "item-sketch")
    # a row for each power of two of items' sizes
    parts = sketch.groupBy("item_part").agg(F.max(F.element_at("sketch", -1)).alias("top"), F.sum("bytes").alias("bytes")).collect()
    held = F.broadcast if sum(r["bytes"] for r in parts) <= broadcast_bytes else (lambda df: df)
    bounds = [max((r["top"] for r in parts if r["item_part"] <= k), default=-(2**63)) for k in range(PARTS)]
    sketch_rows = sketch.select("item_id", "item", "item_part", F.explode("sketch").alias("h"))
    searched = (
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", normalised(F.col("text")).alias("norm"))
        .withColumn("part", size_part(F.greatest(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 2 - words, F.lit(1))))
        .withColumn("bound", F.coalesce(F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("part") + 1), F.lit(-(2**63))))
    )
    doc_sh = (
        searched.select("doc_id", "part", "bound", F.explode(shingles(F.col("norm"), words)).alias("shingle"))
        .select("doc_id", "part", "bound", F.xxhash64("shingle").alias("h"))
        .where(F.col("h") <= F.col("bound"))
    )
    hits = doc_sh.join(held(sketch_rows), "h").where("item_part <= part").select("doc_id", "item_id", "item").distinct()
    hits, _ = save(hits, "leak-candidates")
    whole = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    found = whole.select("doc_id", F.explode(F.array_distinct(shingles(normalised(F.col("text")), words))).alias("shingle"))
    matched = (
        found.join(held(item_sh.select("item_id", "item", "shingle")), "shingle")
        .distinct()
        .groupBy("doc_id", "item_id", "item")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )
    sizes = sketch.select("item_id", "item", F.col("q").alias("n_item"), "need")
    return (
        matched.join(hits, ["doc_id", "item_id", "item"])
        .join(held(sizes), ["item_id", "item"])
        .where(F.col("n_shared") >= F.col("need"))
        .select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )
