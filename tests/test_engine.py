"""Models against independent solutions, nested stages, solver options, large values and the significance plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import stats
from lumenfold.operators import bayes, models, spatial
from lumenfold.plans import significance, stages
from lumenfold.plans.analysis import AnalysisSpec, classify, classify_time_by_time, fit_models, predictions, transfer
from lumenfold.plans.results import combine, plot_descriptor
from lumenfold.sources import simulate
from lumenfold.sources.tensors import TensorFrame, zscore_global
from lumenfold.streaming.score import score_stream


def two(n=80, p=5, gap=1.0, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2 + 1
    return rng.normal(size=(n, p)) + (y == 1)[:, None] * gap, y


def frame(spark, x, y, times=0):
    """Rows of a tensor; with ``times`` the features are cut into that many positions."""
    rows = [(i, int(c), *([t] if times else []), row.tolist()) for i, (v, c) in enumerate(zip(x, y)) for t, row in enumerate(v.reshape(times, -1) if times else [v])]
    schema = "sample_id BIGINT, clabel INT, " + ("t INT, " if times else "") + "features ARRAY<DOUBLE>"
    return TensorFrame(spark.createDataFrame(rows, schema).withColumn("fold", (F.col("sample_id") % 4 + 1).cast("int")), ("t",) if times else ())


def test_lda_solves_the_shrunk_system():
    x, y = two()
    m = models.fit_lda(x, y, {"reg": "shrink", "lambda": 0.3})
    s = sum((y == c).sum() * np.cov(x[y == c], rowvar=False, ddof=0) for c in (1, 2))
    s = 0.7 * s + 0.3 * np.eye(5) * np.trace(s) / 5
    gap = x[y == 1].mean(0) - x[y == 2].mean(0)
    assert np.allclose(s @ m["w"], gap) and m["b"] == pytest.approx(-m["w"] @ (x[y == 1].mean(0) + x[y == 2].mean(0)) / 2)
    tuned = models.fit_lda(x, y, {"reg": "shrink", "lambda": [0.01, 0.3]})
    assert any(np.allclose(tuned["w"], models.fit_lda(x, y, {"reg": "shrink", "lambda": v})["w"]) for v in (0.01, 0.3))


def test_logreg_gradient_vanishes():
    x, y = two(gap=0.7)
    m = models.fit_logreg(x, y, models.DEFAULTS["logreg"] | {"reg": "l2", "lambda": 2.0, "correct_bias": False})
    t = np.where(y == 1, 1.0, -1.0)
    s = t / (1 + np.exp(t * (x @ m["w"] + m["b"])))
    assert np.allclose(-x.T @ s + 2.0 * m["w"], 0, atol=1e-5) and abs(s.sum()) < 1e-5


def test_svm_meets_its_optimality_conditions():
    x, y = two(gap=0.8)
    t = np.where(y == 1, 1.0, -1.0)
    k = x @ x.T + 1
    a, _ = models.dual_descent((k + 1e-9 * np.eye(len(x))) * np.outer(t, t), 1.0, tol=1e-7, max_sweeps=20000)
    margin = t * (k @ (a * t))
    assert (margin[a < 1e-9] > 1 - 1e-4).all() and (margin[a > 1 - 1e-9] < 1 + 1e-4).all()
    assert np.allclose(margin[(a > 1e-6) & (a < 1 - 1e-6)], 1, atol=1e-4)
    m = models.fit_svm(x, y, models.DEFAULTS["svm"] | {"kernel": "linear", "prob": True})
    got = models.predict_svm(m, x)
    assert np.allclose(got["dval"], k @ (a * t), atol=0.02) and ((got["prob"] > 0.5) == (got["dval"] > 0)).mean() > 0.9


@pytest.mark.parametrize("kernel", ["linear", "rbf"])
def test_svm_of_many_samples_needs_no_matrix_of_samples(kernel):
    import tracemalloc

    p = models.DEFAULTS["svm"] | {"kernel": kernel, "gamma": 0.01}
    x, y = two(400, 3, 0.8)
    t, k = np.where(y == 1, 1.0, -1.0), models._kernel(p, x, x) + 1
    a, _ = models.dual_descent((k + 1e-9 * np.eye(len(x))) * np.outer(t, t), 1.0, tol=1e-7, max_sweeps=20000)
    assert np.allclose(models.predict_svm(models.fit_svm(x, y, p), x)["dval"], k @ (a * t), atol=2e-3)
    x, y = two(6000, 3, 0.8)
    tracemalloc.start()
    assert (models.predict_svm(models.fit_svm(x, y, p), x)["pred"] == y).mean() > 0.6
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 6000 * 8 / 2


def test_tuned_svm_of_many_samples_needs_no_matrix_of_samples():
    import tracemalloc

    x, y = two(5000, 3, 0.8)
    tracemalloc.start()
    m = models.fit_svm(x, y, models.DEFAULTS["svm"] | {"kernel": "linear", "c": [0.1, 1.0]})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    each = [models.fit_svm(x, y, models.DEFAULTS["svm"] | {"kernel": "linear", "c": c}) for c in (0.1, 1.0)]
    assert peak < 4000 * 4000 * 8 / 2 and any(np.allclose(m["w"], e["w"]) for e in each)


def test_svm_of_repeated_and_of_separable_samples():
    p = models.DEFAULTS["svm"] | {"kernel": "linear"}
    x, y = two(60, 3, 9.0)
    assert (models.predict_svm(models.fit_svm(x, y, p), x)["pred"] == y).all()
    same = np.repeat(x[:2], 30, 0)
    assert (models.predict_svm(models.fit_svm(same, np.repeat(y[:2], 30), p), x[:2])["pred"] == y[:2]).all()
    m = models.fit_svm(np.ones((10, 2)), np.arange(10) % 2 + 1, p)  # two classes of one point
    assert np.isfinite(models.predict_svm(m, np.ones((1, 2)))["dval"]).all()


def test_kernel_ridge_of_many_samples_needs_no_matrix_of_samples():
    import tracemalloc

    p = models.DEFAULTS["kernel_ridge"]
    x, _ = two(200, 4)
    y = np.sin(x[:, 0])
    k = models._kernel(p, x, x)
    assert np.allclose(models.predict_kernel_ridge(models.fit_kernel_ridge(x, y, p), x)["pred"], k @ np.linalg.solve(k + np.eye(200), y), atol=1e-7)
    x = np.random.default_rng(3).normal(size=(6000, 4)) / 10
    tracemalloc.start()
    got = models.predict_kernel_ridge(models.fit_kernel_ridge(x, np.sin(x[:, 0]), p), x)["pred"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, np.sin(x[:, 0]), atol=0.05) and peak < 6000 * 6000 * 8 / 2


def test_kernel_fda_with_a_linear_kernel_is_the_discriminant():
    x, y = two(60, 4, 0.8)
    k = models.fit_kernel_fda(x, y, models.DEFAULTS["kernel_fda"] | {"kernel": "linear", "reg": "ridge", "lambda": 1e-6})
    a = models.MODELS["kernel_fda"][1](k, x)["pred"]
    b = models.MODELS["multiclass_lda"][1](models.fit_multiclass_lda(x, y, {"reg": "ridge", "lambda": 0.0}), x)["pred"]
    assert (a == b).mean() > 0.98


@pytest.mark.parametrize("kernel", ["linear", "polynomial", "rbf"])
def test_kernel_fda_of_many_samples_needs_no_matrix_of_samples(kernel):
    """The dense discriminant of the definition on few samples; many samples in memory that n x n numbers do not fit."""
    import tracemalloc

    x, y = two(150, 4, 0.8)
    y[::5] = 3
    p = models.DEFAULTS["kernel_fda"] | {"kernel": kernel}
    k, n = models._kernel(p, x, x), len(x)
    m = np.stack([k[:, y == c].mean(1) for c in (1, 2, 3)])
    within = sum(k[:, y == c] @ k[:, y == c].T - (y == c).sum() * np.outer(v, v) for c, v in zip((1, 2, 3), m))
    between = sum((y == c).sum() * np.outer(v - k.mean(1), v - k.mean(1)) for c, v in zip((1, 2, 3), m))
    root = np.linalg.inv(np.linalg.cholesky((1 - p["lambda"]) * within + p["lambda"] * np.eye(n) * np.trace(within) / n))
    a = root.T @ np.linalg.eigh(root @ between @ root.T)[1][:, ::-1][:, :2]
    new = np.random.default_rng(5).normal(size=(40, 4))
    want = models.predict_centroid({"axes": a, "centroids": m @ a, "classes": np.array([1, 2, 3])}, models._kernel(p, new, x))
    got = models.MODELS["kernel_fda"][1](models.fit_kernel_fda(x, y, p), new)
    assert np.allclose(got["prob_all"], want["prob_all"], atol=1e-4) and (got["pred"] == want["pred"]).all()
    x, y = two(6000, 4, 0.8)
    tracemalloc.start()
    model = models.fit_kernel_fda(x / 20, y, p)
    assert (models.MODELS["kernel_fda"][1](model, x / 20)["pred"] == y).mean() > 0.7
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 6000 * 8 / 2


def test_models_of_all_folds_equal_models_of_each():
    x, y = two(90, 3, 0.8)
    fold = np.arange(90) % 4  # fold 0 is trained on only
    for name, fit, predict, target in (("kernel_fda", models.fit_kernel_fda, models.MODELS["kernel_fda"][1], y), ("kernel_ridge", models.fit_kernel_ridge, models.predict_kernel_ridge, x[:, 0] ** 2)):
        p = models.DEFAULTS[name]
        for f, model in models.FOLDS[name](x, target, fold, p, [1, 2, 3]):
            one, other = predict(fit(x[fold != f], target[fold != f], p), x[fold == f]), predict(model, x[fold == f])
            assert all(np.allclose(one[k], other[k], atol=1e-6) for k in one)


def test_ensemble_of_one_whole_learner_is_the_learner():
    x, y = two()
    p = models.DEFAULTS["ensemble"] | {"nlearners": 1, "nfeatures": 5, "nsamples": 40, "replace": False}
    d = models.predict_ensemble(models.fit_ensemble(x, y, p), x)["dval"]
    assert np.allclose(d, models.predict_linear(models.fit_lda(x, y, models.DEFAULTS["lda"]), x)["dval"])


def test_ridge_dual_and_primal_agree():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(10, 30)), rng.normal(size=10)
    m = models.fit_ridge(x, y, models.DEFAULTS["ridge"] | {"lambda": 3.0})
    z = x - x.mean(0)
    assert np.allclose(m["w"], np.linalg.solve(z.T @ z + 3 * np.eye(30), z.T @ (y - y.mean())))


def test_solver_options_become_models():
    s = AnalysisSpec(model="liblinear", hyperparameter={"type": 0, "cost": 4})
    assert s.model == "logreg" and s.params()["lambda"] == 0.25 and s.params()["reg"] == "l2"
    assert AnalysisSpec(model="libsvm", hyperparameter={"kernel": "linear", "cost": [1, 2]}).params()["c"] == [1, 2]
    with pytest.raises(ValueError):
        AnalysisSpec(model="libsvm", hyperparameter={"svm_type": 2})
    x, y = two(gap=2.0)
    m = models.fit_svm(x, y, models.DEFAULTS["svm"] | {"kernel": "rbf", "c": [0.1, 1.0], "gamma": [0.1, 1.0]})
    assert (models.predict_svm(m, x)["pred"] == y).mean() > 0.9


def test_naive_bayes_keeps_the_digits_of_large_values(spark):
    x = np.array([[1e8 + k % 4, k] for k in range(16)], float)
    t = frame(spark, x, np.arange(16) % 2 + 1)
    for got in (bayes.fit_all(t), bayes.fit_folds(t)):
        for r in got.collect():
            test = set() if "fold" not in got.columns else {i for i in range(16) if i % 4 + 1 == r["fold"]}
            for c in r["classes"]:
                rows = x[[i for i in range(16) if i % 2 + 1 == c["c"] and i not in test]]
                assert c["n"] == len(rows) and np.allclose(c["mu"], rows.mean(0)) and np.allclose(c["va"], rows.var(0, ddof=1), rtol=1e-6)


def test_folds_without_a_class_and_classes_in_one_fold(spark):
    x, y = np.arange(8.0)[:, None], np.array([1, 1, 1, 1, 2, 2, 2, 3])
    t = TensorFrame(spark.createDataFrame([(i, int(c), 1 + i % 2 if c != 3 else 1, v.tolist()) for i, (v, c) in enumerate(zip(x, y))], "sample_id BIGINT, clabel INT, fold INT, features ARRAY<DOUBLE>"))
    got = {(r["fold"], c["c"]): c["n"] for r in bayes.fit_folds(t).collect() for c in r["classes"]}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 1): 2, (2, 2): 2, (2, 3): 1}


def test_stages_fit_on_training_rows_only():
    x, y = two(40, 6)
    test, rows = x[:7] * 3 + 1, np.arange(7)
    a, _, apply = stages.ARRAY_STAGES["zscore"](x, y, {})
    assert np.allclose(a.std(0, ddof=1), 1) and np.allclose(apply(test, y[:7], rows)[0], (test - x.mean(0)) / x.std(0, ddof=1))
    a, ya, apply = stages.ARRAY_STAGES["average_samples"](x, y, {"group_size": 3})
    assert len(a) == 12 and (ya == 1).sum() == 6
    b, yb, rb = apply(test, y[:7], rows)
    assert len(b) == 2 and set(yb) == {1, 2} and all(y[r] == c for r, c in zip(rb, yb))
    holes = np.array([[np.nan, 1, np.nan, np.nan, 4], [np.nan] * 5])
    for method, want in (("forward", [np.nan, 1, 1, 1, 4]), ("backward", [1, 1, 4, 4, 4]), ("nearest", [1, 1, 1, 4, 4]), ("fill", [0, 1, 0, 0, 4])):
        got = stages.ARRAY_STAGES["impute_nan"](holes, y[:2], {"method": method})[0]
        assert np.array_equal(got[0], want, equal_nan=True) and (method == "fill") == np.isfinite(got[1]).all()


def test_spatial_stages_separate_bands(spark):
    x, y, _ = simulate.oscillation_arrays(80, 6, 128, bands=((8, 12), (18, 24)), fs=128, seed=1)
    p = {"channels": 6, "n": 1, "calculate_variance": True}
    flat = x.reshape(80, -1)
    a, _, apply = stages.ARRAY_STAGES["csp"](flat[:60], y[:60], p)
    assert a.shape == (60, 2) and apply(flat[60:], y[60:], np.arange(20))[0].shape == (20, 2)
    w, patterns = spatial.fit_csp(x, y, 1)
    assert np.allclose(w.T @ patterns, np.eye(2), atol=1e-8)
    t = frame(spark, flat, y)
    got = classify(t, AnalysisSpec(model="lda", cv="predefined", preprocess=(("csp", p),)), 2).first()["perf"]
    assert got > 0.7
    q = {"channels": 6, "n": 2, "fs": 128, "signal": (8, 12), "noise": (6, 14)}
    assert stages.ARRAY_STAGES["ssd"](flat, y, q)[0].shape == (80, 2 * 128)


def test_generalization_equals_models_of_each_time(spark):
    x, y = two(40, 12, 0.8)
    t = frame(spark, x, y, 3)
    spec = AnalysisSpec(model="lda", cv="predefined", preprocess=(("zscore", {}),))
    got = {(r["t"], r["t_test"]): r["perf"] for r in classify_time_by_time(t, spec).collect()}
    cut = x.reshape(40, 3, 4)
    for a in range(3):
        for b in range(3):
            right = 0
            for f in range(1, 5):
                test = np.arange(40) % 4 + 1 == f
                m, s = cut[~test, a].mean(0), cut[~test, a].std(0, ddof=1)
                lda = models.fit_lda((cut[~test, a] - m) / s, y[~test], models.DEFAULTS["lda"])
                right += (models.predict_linear(lda, (cut[test, b] - m) / s)["pred"] == y[test]).sum()
            assert got[a, b] == pytest.approx(right / 40)
    part = classify_time_by_time(t, spec, train_times=[1], test_times=[0, 2]).collect()
    assert {(r["t"], r["t_test"]): r["perf"] for r in part} == {k: got[k] for k in ((1, 0), (1, 2))}
    diagonal = {r["t"]: r["perf"] for r in classify(t, spec, 2).collect()}
    assert diagonal == {k: got[k, k] for k in range(3)}


def test_predictions_are_fitted_once_for_all_metrics(spark, tmp_path):
    x, y = two(24, 3)
    calls = str(tmp_path)

    def fit(a, b, p):
        import os
        import uuid

        open(os.path.join(calls, uuid.uuid4().hex), "w").close()
        return models.fit_lda(a, b, models.DEFAULTS["lda"])

    models.register_model("counted", fit, models.predict_linear)
    spec = AnalysisSpec(model="counted", cv="predefined", metric=("accuracy", "auc", "f1"))
    assert len({r["metric"] for r in classify(frame(spark, x, y), spec, 2).collect()}) == 3
    import os

    assert len(os.listdir(calls)) == 4


def test_transfer_append_models_and_grouped_leaveout(spark):
    x, y = two(60, 4, 2.0)
    t = frame(spark, x, y, 2)
    assert all(r["perf"] > 0.8 for r in transfer(t.where("fold < 3"), t.where("fold > 2"), AnalysisSpec()).collect())
    a = {r["t"]: r["perf"] for r in classify(t, AnalysisSpec(model="naive_bayes", repeat=2, append=True), 2).collect()}
    b = {r["t"]: r["perf"] for r in classify(t, AnalysisSpec(model="naive_bayes", repeat=2), 2).collect()}
    assert a == pytest.approx(b)
    with pytest.raises(ValueError):
        AnalysisSpec(model="lda", append=True)
    got = predictions(t, AnalysisSpec(cv="leaveout_grouped", group_size=7)).select("fold").distinct().count()
    assert got == 8
    flat = frame(spark, x, y)
    import pickle

    model = pickle.loads(bytes(fit_models(flat, AnalysisSpec()).first()["model"]))
    assert (np.array([r["pred"] for r in score_stream(flat.df, model, "lda").orderBy("sample_id").collect()]) == y).mean() > 0.9
    z = zscore_global(flat).long().agg(F.avg("x"), F.stddev_samp("x")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def test_permutations_keep_labels_and_tell_signal_from_noise(spark):
    x, y = two(48, 6, 0.0)
    x[:, :3] += (y == 1)[:, None] * 3
    x[1::2, 3:] = x[::2, 3:]  # at the second time both classes have the same rows
    t = frame(spark, x, y, 2)
    perm = significance.permuted(t, 7).df
    assert perm.select("perm", "sample_id").distinct().count() == 7 * 48
    assert {tuple(r) for r in perm.groupBy("perm", "t", "clabel").count().select("clabel", "count").collect()} == {(1, 24), (2, 24)}
    spec = AnalysisSpec(model="lda", k=4, repeat=1)
    for correct in ("none", "bonferroni"):
        got, null = significance.permutation_test(t, spec, 30, correct, classes=2)
        p = {r["t"]: (r["stat"], r["p"], r["mask"]) for r in got.collect()}
        assert p[0][1] == 0 and p[0][2] and p[1][1] > 0.05 and not p[1][2] and null.count() == 60
    found = {(r["t"], r["stat"]) for r in null.where("perm = 3").collect()}
    again = {(r["t"], r["stat"]) for r in significance.permutation_test(t, spec, 30, classes=2)[1].where("perm = 3").collect()}
    assert found == again
    got = {r["t"]: (r["p"], r["mask"]) for r in significance.permutation_test(t, spec, 30, "cluster", 0.8, classes=2)[0].collect()}
    assert got[0] == (0.0, True) and got[1] == (None, False)
    b = {r["t"]: r["mask"] for r in significance.binomial_test(t, spec, classes=2).collect()}
    assert b[0] and not b[1]


def test_group_tests(spark):
    rng = np.random.default_rng(4)
    rows = [(s, k, float(rng.normal() + (k == 0) * 2 + 0.5), 1 + s % 2) for s in range(16) for k in range(2)]
    rows = [(s, k, v + (k == 1 and g == 1) * 3.0, g) for s, k, v, g in rows]
    df = spark.createDataFrame(rows, "subject BIGINT, k INT, perf DOUBLE, grp INT")
    for statistic in ("mean", "ttest", "wilcoxon"):
        got = {r["k"]: r for r in significance.group_test(df, ["k"], statistic=statistic, null=0.5, n_permutations=100)[0].collect()}
        assert got[0]["p"] < 0.05 and got[0]["mask"]
        got = {r["k"]: r for r in significance.group_test(df, ["k"], design="between", statistic=statistic, n_permutations=100)[0].collect()}
        assert got[1]["p"] < 0.05 and got[0]["p"] > 0.01
    v, g = np.array([r[2] for r in rows if r[1] == 1]), np.array([r[3] for r in rows if r[1] == 1])
    a, b = v[g == 1], v[g == 2]
    pooled = np.sqrt((7 * a.var(ddof=1) + 7 * b.var(ddof=1)) / 14 * (1 / 8 + 1 / 8))
    t = {r["k"]: r["stat"] for r in stats.two_sample_t(df.withColumnRenamed("perf", "x"), ["k"]).collect()}
    assert t[1] == pytest.approx((a.mean() - b.mean()) / pooled)


def test_ranks_with_ties(spark):
    x = [3.0, 1.0, 3.0, 2.0, 3.0]
    got = sorted((r["x"], r["rank"]) for r in stats.ranks(spark.createDataFrame([("a", v) for v in x], "k STRING, x DOUBLE"), ["k"]).collect())
    assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


def test_results_merge_average_and_describe(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "t INT, perf DOUBLE")
    b = spark.createDataFrame([(0, 3.0), (1, 2.0)], "t INT, perf DOUBLE")
    assert sorted(tuple(r) for r in combine([a, b], "merge", ["t"]).select("result", "t", "perf").collect()) == [(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0), (2, 1, 2.0)]
    assert {r["t"]: (r["perf"], r["n_results"]) for r in combine([a, b], "average", ["t"]).collect()} == {0: (2.0, 2), 1: (2.0, 2)}
    assert plot_descriptor("accuracy", ["t"], 4) == {"kind": "line", "x": "t", "y": "accuracy", "chance": 0.25, "error_band": True, "title": "accuracy"}
