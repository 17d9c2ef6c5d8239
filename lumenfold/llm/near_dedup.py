"""MinHash near-dedup by a multi-index Hamming join.

Each text's set of word shingles is reduced to a signature of ``chunks`` x
``width`` MinHash symbols of ``BITS`` bits. Two signatures that differ in at most
``chunks * 2 - 1`` symbols have, by pigeonhole, a chunk that differs in at most
one symbol; every chunk is therefore indexed ``width`` times, each time with one
symbol left out (the allowed error enumerated), and equal index keys give every
pair under that distance. ``layout`` sets both numbers from the similarity asked
for, so that a pair at the very threshold is missed (all chunks have two errors
or more) with a probability of at most ``MISS``; pairs above it, less. A
similarity that ``SKETCH`` symbols cannot hold that way (under a tenth) is refused.
Found links are confirmed on the full shingle sets.

No group is ever expanded into all its pairs:

* texts of equal shingle sets become one class before the search;
* within an index key, members are first compared with the key's most connected
  member (hub) only, and confirmed links are contracted to components;
* hub pairs whose 128-bit sketches are too far apart (over six standard
  deviations beyond the threshold) are not verified then;
* keys that still hold several components go on: documents connected by them are
  compared exactly, each pair once, in blocks of a bounded number of documents,
  and only links that join two components are returned.

Contract: words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; the
set holds the distinct ``words``-word shingles, or the whole sequence where a
text has fewer words. Null, empty and blank texts have the empty set, are linked
with nothing and are their own component. Repeated rows of one id count as one
node for links and are returned as often as they occur; if their texts differ,
links to other sets are confirmed on the text of the least set key. Rows with a
null ``doc_id`` are returned with a null component and ``kept`` true. Empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashCache, drop_path, mix, save, slices, word_hash
from .components import components

SKETCH, BITS, WIDEST = 128, 16, 6
#: Greatest probability to miss a pair at the threshold.
MISS = 2e-6


def layout(percent: int) -> tuple[int, int]:
    """(chunks, width): the widest chunks, ``WIDEST`` symbols at most, that miss few enough pairs of ``percent`` similarity."""
    j = percent / 100
    for width in range(WIDEST, 1, -1):
        two = 1 - j**width - width * j ** (width - 1) * (1 - j)
        chunks = 1 if two <= MISS else math.ceil(math.log(MISS) / math.log(two))
        if chunks * width <= SKETCH:
            return chunks, width
    raise ValueError(f"similarity of {percent} % is too low for {SKETCH} symbols")


def sketch_errors(percent: int) -> int:
    """Sketch bits that may differ: their mean at the threshold and 6.4 deviations."""
    p = (1 - percent / 100) / 2
    return math.floor(SKETCH * p + 6.4 * math.sqrt(SKETCH * p * (1 - p)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (base[:SKETCH] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (base[SKETCH:] >> np.uint64(32)).astype(np.uint32)


MUL, ADD = _multipliers()


def shingle_set(text: str | None, words: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    if not text:
        return np.empty(0, np.uint64)
    h = word_hash(text.encode("utf-8", "surrogatepass").lower().split(), cache)
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out ^ h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """``SKETCH`` 32-bit MinHash symbols of a set of hashes."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 4096):
        part = low[start : start + 4096]
        x = part[None, :] * MUL[:, None] + ADD[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def index_keys(sig: np.ndarray, chunks: int, width: int) -> np.ndarray:
    """One 64-bit key for each chunk of b-bit symbols and each symbol left out of it."""
    place = np.arange(chunks * width, dtype=np.uint64)
    sym = mix((sig[: chunks * width].astype(np.uint64) & np.uint64((1 << BITS) - 1)) + (place << np.uint64(32))).reshape(chunks, width)
    return mix(sym.sum(axis=1, keepdims=True) - sym + place.reshape(chunks, width)).ravel()


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())),
])


def _sign(words: int, chunks: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for whole in batches:
            for batch in slices(whole):
                ids, n, key, keys, sketch = batch.column("doc_id"), [], [], [], []
                for text in batch.column("text").to_pylist():
                    s = shingle_set(text, words, cache)
                    n.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    if len(s):
                        sig = signature(s)
                        keys.append(index_keys(sig, chunks, width).view(np.int64))
                        sketch.append(np.packbits((sig >> np.uint32(7)).astype(np.uint8) & 1).view(np.int64))
                    else:
                        keys.append(np.empty(0, np.int64))
                        sketch.append(np.zeros(2, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    names=[f.name for f in SIGNED],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for whole in batches:
            for batch in slices(whole):
                sets = [shingle_set(text, words, cache) for text in batch.column("text").to_pylist()]
                keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "set_key", "s"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("i") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _near(percent: int, a: str = "x", b: str = "y") -> Column:
    """Sizes that allow the similarity, and sketches within reach of it."""
    errors = F.lit(0)
    for k in (0, 1):
        errors = errors + F.bit_count(F.col(f"{a}.k{k}").bitwiseXOR(F.col(f"{b}.k{k}")))
    return (
        (F.col(f"{a}.n") * 100 >= percent * F.col(f"{b}.n")) & (F.col(f"{b}.n") * 100 >= percent * F.col(f"{a}.n")) & (errors <= sketch_errors(percent))
    )


def links(docs: DataFrame, words: int = 3, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(signed, comp): one row per document with its set's key, and (id, comp) of all linked class representatives."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed, _ = save(docs.mapInArrow(_sign(words, *layout(percent)), SIGNED), "signed")
    classes = (
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "n_shingles", "sketch", "keys")).alias("r")).select("r.*")
    )
    reps, reps_path = save(classes, "classes")
    rows = reps.select(F.col("doc_id").alias("d"), F.explode("keys").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    about = reps.select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"), F.col("sketch")[0].alias("k0"), F.col("sketch")[1].alias("k1"))
    met, met_path = save(rows.join(counts, "key"), "index-hits")
    known, known_path = save(met.select("key", "d").join(met.groupBy("d").agg(F.sum("c").alias("deg")).join(about, "d"), "d"), "index-known")
    for path in (reps_path, met_path):
        drop_path(spark, path)
    hub = known.groupBy("key").agg(F.max(F.struct("deg", F.col("d").alias("d"), "n", "k0", "k1")).alias("h")).select("key", "h.*")
    first = (
        known.alias("y").join(hub.alias("x"), "key").where(F.col("x.d") != F.col("y.d")).where(_near(percent))
        .select(F.least("x.d", "y.d").alias("a"), F.greatest("x.d", "y.d").alias("b")).distinct()
    )
    first, first_path = save(first, "hub-pairs")
    wanted = known.select(F.col("d").alias("doc_id")).distinct()
    found = docs.where("doc_id IS NOT NULL").join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id BIGINT, set_key BINARY, s ARRAY<BIGINT>")
    sets, sets_path = save(found.groupBy("doc_id").agg(F.min(F.struct("set_key", "s")).alias("m")).select("doc_id", "m.s"), "sets")
    edges, edges_path = save(_confirmed(first, sets, percent), "hub-links")
    comp = components(edges)
    parts = known.select("key", "d").join(comp.withColumnRenamed("id", "d"), "d", "left").withColumn("comp", F.coalesce("comp", "d"))
    mixed = parts.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("d").alias("head")).where("lo <> hi").select("key", "head")
    rest, rest_path = save(parts.join(mixed, "key").select("d", "comp", "head").distinct(), "index-rest")
    # what the blocks find joins components, so that only those are walked again
    more, more_path = save(_rest_links(rest, sets, percent), "links")
    joined = components(more).select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    every = comp.union(joined.select(F.col("comp").alias("id"), "comp")).groupBy("id").agg(F.min("comp").alias("comp"))
    named, _ = save(every.join(joined, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "components")
    for path in (known_path, first_path, sets_path, edges_path, rest_path, more_path):
        drop_path(spark, path)
    return signed, named


def _rest_links(rest: DataFrame, sets: DataFrame, percent: int, block: int = 200) -> DataFrame:
    """Links (a, b) between components of documents which share an index key: (d, comp, head of the key).

    Documents connected by shared keys form a cluster, in which every pair is compared once: clusters are cut into
    blocks of about ``block`` documents, a task takes two blocks, intersections come from products of membership
    matrices, and only links that join two components leave it.
    """
    cluster = components(rest.where("d <> head").select(F.col("d").alias("a"), F.col("head").alias("b"))).select(F.col("id").alias("d"), F.col("comp").alias("cl"))
    members = rest.select("d", "comp").distinct().join(cluster, "d")
    sizes = members.groupBy("cl").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    placed = members.join(sizes, "cl").withColumn("own", F.pmod(F.xxhash64("d"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    placed = placed.select("cl", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "d", "comp")
    joined = placed.join(sets.withColumnRenamed("doc_id", "d"), "d")

    def compare(key, part: pd.DataFrame) -> pd.DataFrame:
        found = block_links(part["s"].tolist(), part["comp"].to_numpy(), part["own"].to_numpy() == key[1], key[1] == key[2], percent)
        c = part["comp"].to_numpy()
        return pd.DataFrame({"a": [min(c[i], c[j]) for i, j in found], "b": [max(c[i], c[j]) for i, j in found]}, dtype="int64")

    return joined.groupBy("cl", "lo", "hi").applyInPandas(compare, "a BIGINT, b BIGINT")


def block_links(sets: list[np.ndarray], comp: np.ndarray, first: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between rows of the first and the second block (or within one) that join components, as a spanning forest."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if len(sets) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    number = np.cumsum(times > 1) - 1
    col, owner = number[col[shared]], owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    left = np.arange(len(sets)) if same else np.flatnonzero(first)
    right = np.arange(len(sets)) if same else np.flatnonzero(~first)
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    top = int(col[-1]) + 1 if len(col) else 0
    for start in range(0, top, 2048):
        a, b = np.searchsorted(col, [start, start + 2048])
        x = np.zeros((len(left), 2048), np.float32)
        y = np.zeros((len(right), 2048), np.float32)
        for m, where in ((x, place[0, owner[a:b]]), (y, place[1, owner[a:b]])):
            ok = where >= 0
            m[where[ok], col[a:b][ok] - start] = 1
        common += x @ y.T
    i = common.astype(np.int64)
    hit = (100 * i >= percent * (size[left][:, None] + size[right][None] - i)) & (comp[left][:, None] != comp[right][None])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    out = []
    for p, q in np.argwhere(hit):
        a, b = find(comp[left[p]]), find(comp[right[q]])
        if a != b:
            root[a] = b
            out.append((left[p], right[q]))
    return out


def near_dedup(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed, comp = links(docs, words, percent)
    rep = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    # written, so that no aggregation shares a stage with the join below and a hot set's rows can be split
    named, _ = save(rep.join(comp, "id", "left").select("set_key", F.coalesce("comp", "id").alias("component_id")), "set-components")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "set_key").join(named, "set_key")
    none = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "component_id").union(none).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
