"""Queries over whole tables, against numpy on small fixtures."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenfold import catalog
from lumenfold.functions import stats

N = 150


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    rng = np.random.default_rng(7)
    x, label = rng.normal(size=(N, 64)).astype(np.float32), (np.arange(N) % 2).astype(np.int32)
    home = tmp_path_factory.mktemp("vectors")
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(N)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(label)}), home / "embeddings.parquet")
    return str(home), x.astype(float), label


@pytest.mark.parametrize("name", ["linear", "polynomial", "rbf"])
def test_kernels_hold_all_pairs(spark, vectors, name):
    home, x, _ = vectors
    dots = x @ x.T
    sq = np.diag(dots)[:, None] + np.diag(dots)[None] - 2 * dots
    want = {"linear": dots, "polynomial": (dots * 0.5 + 1) ** 2, "rbf": np.exp(-0.1 * sq)}[name]
    got = catalog.QUERIES[f"kernel_{name}"](spark, home).toPandas()
    assert len(got) == N * (N + 1) // 2 and (got["i"] <= got["j"]).all() and not got.duplicated(["i", "j"]).any()
    assert np.allclose(got["k"], want[got["i"], got["j"]], atol=2e-6)


def test_averaged_kernel_holds_all_groups(spark, vectors):
    home, x, label = vectors
    key = (np.arange(N) * 1103515245 + 12345) % 2**31
    means = {}
    for c in (0, 1):
        ids = np.flatnonzero(label == c)
        ids = ids[np.lexsort((ids, key[ids]))]
        means |= {c * 1000 + g: x[ids[3 * g : 3 * g + 3]].mean(0) for g in range(len(ids) // 3)}
    got = {(r["gi"], r["gj"]): r["k"] for r in catalog.prep_average_kernel(spark, home).collect()}
    assert len(got) == len(means) ** 2
    assert all(abs(got[a, b] - means[a] @ means[b]) < 2e-6 for a in means for b in means)


def test_kernels_by_blocks_equal_the_self_join(spark, monkeypatch):
    """Repeated ids, groups of unlike size and many blocks; the tables' way for large or odd samples gives the same."""
    from pyspark.sql import functions as F

    from lumenfold.functions import kernels

    monkeypatch.setattr(kernels, "SIDE", 7)
    monkeypatch.setattr(kernels, "PAIRS_PER_BATCH", 40)
    rng = np.random.default_rng(3)
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(np.append(np.arange(40), [5, 5, 39])), rng.normal(size=(43, 4)))]
    df = spark.createDataFrame(rows, "sample_id BIGINT, features ARRAY<DOUBLE>")
    member = spark.createDataFrame([(i, int(g)) for i, g in enumerate(rng.integers(0, 9, 38))], "sample_id BIGINT, grp INT")
    pairs = lambda d: sorted((r[0], r[1], round(r[2], 5)) for r in d.collect())
    for kernel, params in (("linear", {}), ("polynomial", {"gamma": 0.5}), ("rbf", {"gamma": 0.1})):
        fast, slow = (kernels.kernel_matrix(df, kernel, regularise=0.5, broadcast_bytes=size, digits=6, **params) for size in (10**9, 500))
        assert fast.count() == slow.count() > 900
        assert np.allclose(pairs(fast), pairs(slow), atol=2e-5)
        fast, slow = (kernels.averaged_kernel_matrix(df, member, kernel, size, 6, **params) for size in (10**9, 500))
        assert fast.count() == 81 and np.allclose(pairs(fast), pairs(slow), atol=2e-5)
    # no task carries a row per pair through an expression of the JVM: it is a matrix product of blocks
    plan = kernels.kernel_matrix(df, "linear")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    empty = df.where(F.lit(False))
    assert kernels.kernel_matrix(empty, "linear").count() == 0 and kernels.averaged_kernel_matrix(empty, member, "linear").count() == 0
    holes = df.unionByName(spark.createDataFrame([(77, None)], df.schema))
    assert kernels.kernel_matrix(holes, "linear").count() == kernels.kernel_matrix(df, "linear").count() + 44


def exact_tail(hits, n):
    return float(Fraction(sum(math.comb(n, k) for k in range(hits + 1, n + 1)), 2**n))


def test_binomial_counts_all_orders(spark, tmp_path):
    n = 3000
    pq.write_table(pa.table({"o_orderkey": np.arange(n), "o_custkey": np.arange(n) * 7 // 5 + np.arange(n) % 3, "o_orderpriority": [str(i % 3) for i in range(n)]}), tmp_path / "orders.parquet")
    rows = [(str(i % 3), (i * 7 // 5 + i % 3) % 2 == 0) for i in range(n)]
    want = {k: exact_tail(sum(even for p, even in rows if p == k), 1000) for k in "012"}
    got = {r["k"]: r["p"] for r in catalog.stat_binomial(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_binomial_tail():
    for n, hits in ((1, 0), (5, -1), (5, 0), (5, 5), (11, 5), (40, 39), (101, 50), (1001, 480), (3000, 1570), (4000, 2040)):
        assert math.isclose(stats.binomial_tail(hits, n, 0.5), exact_tail(max(hits, -1), n), rel_tol=1e-10)
    for n in (11, 1001, 10**6 + 1, 10**9 + 1):  # by symmetry
        assert math.isclose(stats.binomial_tail(n // 2, n, 0.5), 0.5, rel_tol=1e-9)
    third = [math.comb(30, k) * (1 / 3) ** k * (2 / 3) ** (30 - k) for k in range(31)]
    assert all(math.isclose(stats.binomial_tail(h, 30, 1 / 3), sum(third[h + 1 :]), rel_tol=1e-9) for h in range(30))


@pytest.mark.parametrize("name", ["linear", "rbf"])
def test_pairs_take_fewer_bytes_than_their_values(spark, tmp_path, name):
    """Files of all pairs, which grow with the square of the table: a pair took more than the 8 bytes of its value."""
    n, rng = 2100, np.random.default_rng(5)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n) * 3), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(np.zeros(n, np.int32))}), tmp_path / "embeddings.parquet")
    catalog.QUERIES[f"kernel_{name}"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    got = pq.read_table(tmp_path / "out").to_pandas()
    x = x.astype(float)
    want = x @ x.T if name == "linear" else np.exp(-0.1 * (2 - 2 * x @ x.T))
    assert len(got) == n * (n + 1) // 2 and (got["i"] <= got["j"]).all() and not got.duplicated(["i", "j"]).any()
    assert np.allclose(got["k"], want[got["i"] // 3, got["j"] // 3], atol=2e-6) and (got["k"] == np.round(got["k"], 6)).all()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 7.5 * len(got)


def test_ordered_pairs_of_odd_samples(spark, monkeypatch):
    """Ids shared by more samples than a block holds, values too large to order, infinite and undefined ones."""
    from lumenfold.functions import kernels

    monkeypatch.setattr(kernels, "SIDE", 4)
    monkeypatch.setattr(kernels, "ORDERED_SIDE", 5)
    monkeypatch.setattr(kernels, "PAIRS_PER_BATCH", 7)
    rng = np.random.default_rng(11)
    ids = np.append(np.arange(-9, 20), [3] * 12)
    x = rng.normal(size=(len(ids), 3))
    for scale, odd in ((1.0, []), (1e-4, []), (1e7, []), (1e120, []), (1.0, [np.nan, np.inf])):
        z = x * scale
        z[: len(odd), 0] = odd
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, z)], "sample_id BIGINT, features ARRAY<DOUBLE>")
        with np.errstate(all="ignore"):
            k = np.round((z[:, None] * z[None]).sum(-1) + 0.5 * (ids[:, None] == ids), 6)
        on = ids[:, None] <= ids
        pick = lambda i, j, v: np.array(v)[np.lexsort((np.nan_to_num(v, nan=np.inf), j, i))]
        a, b = np.broadcast_to(ids[:, None], on.shape)[on], np.broadcast_to(ids, on.shape)[on]
        got = kernels.kernel_matrix(df, "linear", regularise=0.5, digits=6).toPandas()
        assert sorted(zip(got["i"], got["j"])) == sorted(zip(a, b))
        assert np.allclose(pick(got["i"], got["j"], got["k"]), pick(a, b, k[on]), atol=2e-6, rtol=1e-12, equal_nan=True)
