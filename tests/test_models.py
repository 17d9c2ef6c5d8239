"""Worked values, invariants and agreement of two paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import metrics, stats
from lumenfold.operators import models, solvers, spatial
from lumenfold.plans.analysis import AnalysisSpec, classify, regress
from lumenfold.sources import simulate
from lumenfold.sources.tensors import TensorFrame


@pytest.mark.parametrize("cells,want", [((20, 5, 10, 15), 0.4), ((45, 15, 25, 15), 0.1304), ((25, 35, 5, 35), 0.2593)])
def test_kappa_worked(spark, cells, want):
    rows = [(i, j) for (i, j), n in zip(((1, 1), (1, 2), (2, 1), (2, 2)), cells) for _ in range(n)]
    got = metrics.kappa(spark.createDataFrame(rows, "y INT, pred INT"), [], 2).first()["perf"]
    assert got == pytest.approx(want, abs=1e-4)


def test_f1_all_wrong_is_nan(spark):
    got = metrics.per_class(spark.createDataFrame([(1, 2), (2, 1)], "y INT, pred INT"), [], 2, "f1").first()["perf"]
    assert np.isnan(got)


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (1, 2.0), (2, 0.0)], "y INT, dval DOUBLE")
    assert metrics.auc(df, []).first()["perf"] == pytest.approx(3.5 / 4)


def test_rank_sum_worked(spark):
    rows = [(1, x) for x in (7.1, 5.0, 6.0, 4.0, 12.0)] + [(2, x) for x in (3.0, 6.0, 4.0, 2.0, 1.0)]
    assert stats.rank_sum(spark.createDataFrame(rows, "grp INT, x DOUBLE"), []).first()["u"] == 3


def test_components_of_a_mask():
    m = np.array([[1, 1, 0], [0, 0, 1], [1, 0, 0]], bool)
    assert stats.label_components(m)[1] == 3
    assert stats.label_components(m, True)[1] == 2


@pytest.mark.parametrize("name", ["lda", "logreg", "svm", "naive_bayes", "ensemble", "multiclass_lda", "kernel_fda"])
def test_separable_classes_are_told_apart(name):
    rng = np.random.default_rng(1)
    y = np.repeat([1, 2], 60)
    x = rng.normal(size=(120, 4)) + (y == 1)[:, None] * 3
    p = models.DEFAULTS[name] | ({"nlearners": 10, "nfeatures": 0.5} if name == "ensemble" else {})
    fit, predict = models.MODELS[name]
    assert (predict(fit(x[::2], y[::2], p), x[1::2])["pred"] == y[1::2]).mean() > 0.95


def test_ridge_without_penalty_is_least_squares_and_kernel_ridge_agrees():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    y = x @ [1.0, -2, 0.5] + 3 + rng.normal(size=50) * 0.1
    m = models.fit_ridge(x, y, models.DEFAULTS["ridge"] | {"lambda": 0.0})
    want = np.linalg.lstsq(np.hstack([x, np.ones((50, 1))]), y, rcond=None)[0]
    assert np.allclose(np.append(m["w"], m["b"]), want)
    z, yc = x - x.mean(0), y - y.mean()
    k = models.fit_kernel_ridge(z, yc, models.DEFAULTS["kernel_ridge"] | {"kernel": "linear", "lambda": 2.0})
    r = models.fit_ridge(z, yc, models.DEFAULTS["ridge"] | {"lambda": 2.0})
    assert np.allclose(models.predict_kernel_ridge(k, z)["pred"], models.predict_ridge(r, z)["pred"])


def test_multiclass_axes_have_unit_scatter():
    x, y = simulate.gaussian_arrays(120, 10, 3)
    m = models.fit_multiclass_lda(x, y, {"reg": "ridge", "lambda": 0.0})
    s = models._scatter(x, y)[0]
    assert np.allclose(m["axes"].T @ s @ m["axes"], np.eye(2), atol=1e-6)


def test_newton_and_whitening():
    w, _ = solvers.trust_newton(lambda v: ((v**2).sum(), 2 * v, 2 * np.eye(2)), np.array([3.0, -4.0]))
    assert np.allclose(w, 0)
    x = np.random.default_rng(0).normal(size=(100, 20)) @ np.random.default_rng(1).normal(size=(20, 20))
    assert np.allclose(np.cov(spatial.project(spatial.fit_pca(x, 5), x), rowvar=False), np.eye(5), atol=1e-8)


def test_correlation_bound_is_met():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    y = x @ rng.normal(size=5) + rng.normal(size=200) * 2
    m = models.fit_ridge(x, y, models.DEFAULTS["ridge"] | {"lambda": 50.0, "correlation_bound": 0.1})
    assert abs(np.corrcoef(y, y - models.predict_ridge(m, x)["pred"])[0, 1]) == pytest.approx(0.1, abs=1e-6)


def test_engine_paths(spark):
    t = TensorFrame(simulate.gaussian(spark, 80, 4).withColumn("fold", (F.col("sample_id") % 4 + 1).cast("int")))
    got = classify(t, AnalysisSpec(model="lda", cv="predefined", metric=("accuracy", "auc"), preprocess=(("zscore", {}),)), 2).collect()
    assert {r["metric"] for r in got} == {"accuracy", "auc"} and all(0 <= r["perf"] <= 1 for r in got)
    r = TensorFrame(simulate.regression(spark, "linear", 80, 3), label="y")
    assert {x["metric"]: x["perf"] for x in regress(r, AnalysisSpec(model="ridge", metric=("r_squared",), repeat=1)).collect()}["r_squared"] > 0.8
    with pytest.raises(ValueError):
        AnalysisSpec(model="unknown")


def test_split_keeps_every_fold(spark):
    from lumenfold.operators import folds

    samples = spark.range(1, 1203).select(F.col("id").alias("sample_id"))
    got = folds.split(samples, folds.leaveout(samples)).where("is_test")
    assert got.count() == got.select("fold").distinct().count() == 1202
