"""Kernel functions over arrays, and kernel matrices as pair tables."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PAIRS_PER_TASK = 1_000_000
#: Samples on a side of a block of pairs, and pairs of one Arrow batch.
SIDE, PAIRS_PER_BATCH = 1024, 131_072
#: Where a task orders one block of pairs by the rounded kernel: samples on a side at most, and blocks of samples if they come to ``SIDE``.
ORDERED_SIDE, ORDERED_BLOCKS = 4096, 7


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def linear(a: Column, b: Column) -> Column:
    return dot(a, b)


def polynomial(a: Column, b: Column, gamma: float = 1.0, coef0: float = 1.0, degree: float = 2) -> Column:
    return F.pow(dot(a, b) * gamma + coef0, F.lit(degree))


def rbf(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


KERNELS: dict[str, Callable[..., Column]] = {"linear": linear, "polynomial": polynomial, "rbf": rbf}


def register_kernel(name: str, column_form: Callable[..., Column], array_form: Callable[..., np.ndarray]) -> None:
    """Make a kernel known by name to pair tables and to the models."""
    KERNELS[name] = column_form
    ARRAY_KERNELS[name] = array_form


def _array_kernel(kernel: str, params: dict) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The kernel on arrays, with the defaults of its column form."""
    defaults = {k: v.default for k, v in inspect.signature(KERNELS[kernel]).parameters.items() if v.default is not v.empty}
    form, given = ARRAY_KERNELS[kernel], defaults | params
    return lambda x, z: form(x, z, **given)


def _shape(df: DataFrame) -> tuple[int, int, bool]:
    """(rows, values of the longest, whether all rows have that many and none is null)."""
    size = df.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("p"), F.min(F.size("features")).alias("least"),
        F.count("features").alias("has"), F.min(F.forall("features", lambda v: v.isNotNull())).alias("full"),
    ).first()
    n, p = size["n"] or 0, max(size["p"] or 0, 0)
    return n, p, bool(n and p and size["least"] == p and size["has"] == n and size["full"])


def _block_pairs(df: DataFrame, name: str, p: int, kernel: Callable, reduce_: bool, digits: int | None, regularise: float = 0.0) -> DataFrame:
    """Pairs by blocks of ``SIDE`` samples in order of ``name``: every worker has the samples, a task has pairs of blocks.

    Rows (i, j, k): of samples with i <= j, or (``reduce_``) means of all ordered pairs of equal-``name`` groups.
    Rounded pairs of samples come a block to a task, in order of k: there equal values follow each other and a block has
    few ids, so that files take half the bytes of rows in order of ids, whose values don't repeat within what codecs see.
    """
    spark = df.sparkSession
    got = df.select(F.col(name).cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("x")).where("id IS NOT NULL").toArrow().combine_chunks()
    ids = got.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in got.column("x").chunks] or [np.zeros(0)]).reshape(len(ids), p)[order]
    ids = ids[order]
    del got
    # equal ids stay in one block, so that other blocks are wholly before or after it
    starts = np.flatnonzero(np.concatenate([[True], np.diff(ids) != 0])) if len(ids) else np.zeros(0, int)
    ordered, side = not reduce_ and digits is not None and digits >= 0, SIDE
    if ordered:
        least = max(-(-len(ids) // ORDERED_SIDE), min(len(ids) // SIDE, ORDERED_BLOCKS), 1)
        side = -(-len(ids) // least) or 1
    block = starts // side
    edges = np.append(starts[np.concatenate([[True], np.diff(block) != 0])] if len(starts) else starts, len(ids))
    blocks = len(edges) - 1
    grid = np.argwhere(np.ones((blocks, blocks)) if reduce_ else np.triu(np.ones((blocks, blocks))))
    shared = spark.sparkContext.broadcast((ids, x, edges, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, edges, grid = shared.value
        for batch in batches:
            for number in batch.column(0).to_numpy():
                u, v = grid[number]
                a, b = slice(edges[u], edges[u + 1]), slice(edges[v], edges[v + 1])
                yield from (_reduced if reduce_ else _ordered if ordered else _upper)(ids[a], ids[b], x[a], x[b], u == v)

    def rows(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        k = np.round(k, digits) + 0.0 if digits is not None else k
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(k)], names=["i", "j", "k"])

    def _upper(ia, ib, xa, xb, same):
        step = max(1, PAIRS_PER_BATCH // len(ib))
        for at in range(0, len(ia), step):
            one = ia[at : at + step]
            k = kernel(xa[at : at + step], xb)
            i, j, k = np.repeat(one, len(ib)), np.tile(ib, len(one)), k.ravel()
            if same:
                on = i <= j
                i, j, k = i[on], j[on], k[on]
                k = k + np.where(i == j, regularise, 0.0) if regularise else k
            yield rows(i, j, k)

    def _ordered(ia, ib, xa, xb, same):
        high = max(1, ORDERED_SIDE**2 // len(ib))  # less than the block only where many samples share an id
        for top in range(0, len(ia), high):
            one, x = ia[top : top + high], xa[top : top + high]
            # the rounded value, the row and the column in one integer, as far as they fit
            low = (len(ib) - 1).bit_length()
            bits = low + (len(one) - 1).bit_length()
            key, fit, step = np.empty((len(one), len(ib)), np.int64), True, max(1, PAIRS_PER_BATCH // len(ib))
            for at in range(0, len(one), step):
                k = kernel(x[at : at + step], xb)
                if regularise and same:
                    k = k + np.where(one[at : at + step, None] == ib, regularise, 0.0)
                k = np.rint(k * 10.0**digits)
                if not (fit := bool(np.abs(k).max() < 2.0 ** (62 - bits))):
                    break
                place = (np.arange(at, at + len(k))[:, None] << low) + np.arange(len(ib))
                key[at : at + step] = (k.astype(np.int64) << bits) + place
            if not fit:
                yield from _upper(one, ib, x, xb, same)
                continue
            key = key[one[:, None] <= ib] if same else key.ravel()
            key.sort()
            for at in range(0, len(key), PAIRS_PER_BATCH):
                part = key[at : at + PAIRS_PER_BATCH]
                i, j, k = one[(part >> low) & ((1 << (bits - low)) - 1)], ib[part & ((1 << low) - 1)], (part >> bits) / 10.0**digits
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(k)], names=["i", "j", "k"])

    def _reduced(ga, gb, xa, xb, same):
        first = lambda g: np.flatnonzero(np.concatenate([[True], np.diff(g) != 0]))
        sa, sb = first(ga), first(gb)
        nb, of_b = np.diff(np.append(sb, len(gb))), gb[sb]
        ends, step, at = np.append(sa, len(ga)), max(1, PAIRS_PER_BATCH // len(gb)), 0
        while at < len(sa):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + step, "right")) - 1)
            k = kernel(xa[ends[at] : ends[stop]], xb)
            k = np.add.reduceat(np.add.reduceat(k, sb, axis=1), ends[at:stop] - ends[at], axis=0) / np.diff(ends[at : stop + 1])[:, None] / nb
            yield rows(np.repeat(ga[sa[at:stop]], len(of_b)), np.tile(of_b, stop - at), k.ravel())
            at = stop

    if ordered:  # one block to a task, without a shuffle, which would deal them unevenly
        numbers = spark.range(0, len(grid), 1, max(len(grid), 1))
    else:
        tasks = min(blocks * blocks, max(len(ids) ** 2 // (PAIRS_PER_TASK * 16), min(blocks * blocks, 24))) or 1
        numbers = spark.range(len(grid)).repartition(tasks)
    return numbers.mapInArrow(run, "i BIGINT, j BIGINT, k DOUBLE")


def _rounded(k: Column, digits: int | None) -> Column:
    return k if digits is None else F.round(k, digits) + F.lit(0.0)


def kernel_matrix(df: DataFrame, kernel: str, search: tuple[str, ...] = (), regularise: float = 0.0, broadcast_bytes: int = 256_000_000, digits: int | None = None, **params) -> DataFrame:
    """Pair table (i, j, search..., k), i <= j, ``k`` rounded to ``digits``.

    The result has a row per pair, as kernel methods need. Without search dimensions, and if the measured size allows,
    every worker gets the samples and computes blocks of pairs as matrix products. Otherwise it is a self-join on the
    search dimensions, one side broadcast if its size allows, or else by blocks of samples.
    """
    side = lambda n: df.select(F.col("sample_id").alias(n), *search, F.col("features").alias(f"x_{n}"))
    n, p, even = _shape(df)
    cells = n * p * 8
    if not search and even and cells <= broadcast_bytes and dict(df.dtypes)["sample_id"] == "bigint":
        return _block_pairs(df, "sample_id", p, _array_kernel(kernel, params), False, digits, regularise)
    a, b = side("i"), side("j")
    if cells <= broadcast_bytes:
        b = F.broadcast(b)
        pairs = a.join(b, list(search)) if search else a.repartition(n**2 // PAIRS_PER_TASK + 1, "i").crossJoin(b)
    else:
        blocks = int(np.ceil(np.sqrt(cells / broadcast_bytes))) * 4
        grid = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        a = a.withColumn("bi", F.pmod(F.xxhash64("i"), F.lit(blocks))).withColumn("bj", grid)
        b = b.withColumn("bj", F.pmod(F.xxhash64("j"), F.lit(blocks))).withColumn("bi", grid)
        pairs = a.join(b, [*search, "bi", "bj"])
    k = KERNELS[kernel](F.col("x_i"), F.col("x_j"), **params)
    return pairs.where("i <= j").select("i", "j", *search, _rounded(k + F.when(F.col("i") == F.col("j"), regularise).otherwise(0.0), digits).alias("k"))


def averaged_kernel_matrix(df: DataFrame, member: DataFrame, kernel: str, broadcast_bytes: int = 256_000_000, digits: int | None = None, **params) -> DataFrame:
    """(gi, gj, k): the kernel averaged over groups of samples (``member``: sample_id, grp) on both axes.

    Blocks of the kernel are averaged where they are computed; a table too large for that goes through the pair table.
    """
    from ..operators.preprocess import average_kernel

    n, p, even = _shape(df)
    if even and n * p * 8 <= broadcast_bytes:
        got = _block_pairs(df.join(member.select("sample_id", "grp"), "sample_id"), "grp", p, _array_kernel(kernel, params), True, digits)
        return got.select(F.col("i").alias("gi"), F.col("j").alias("gj"), "k")
    half = kernel_matrix(df, kernel, broadcast_bytes=broadcast_bytes, **params)
    both = half.union(half.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))
    return average_kernel(both, member).select("gi", "gj", _rounded(F.col("k"), digits).alias("k"))


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


ARRAY_KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "linear": lambda a, b, **_: a @ b.T,
    "polynomial": lambda a, b, gamma=None, coef0=1.0, degree=2, **_: ((gamma or 1 / a.shape[1]) * (a @ b.T) + coef0) ** degree,
    "rbf": lambda a, b, gamma=None, **_: np.exp(-(gamma or 1 / a.shape[1]) * _sq(a, b)),
}
