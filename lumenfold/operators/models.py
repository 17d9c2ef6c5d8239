"""Models fitted to one group of samples in numpy, by name: ``fit(x, y, params) -> model``, ``predict(model, x) -> outputs``.

Classifier outputs are a dict of ``pred`` (1..C), and ``dval`` / ``prob`` where defined; class 1 is positive.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np

from . import lowrank
from .solvers import dual_descent, factored_dual, ledoit_wolf_lambda, platt, trust_newton, tune  # noqa: F401

#: Defaults of the hyper-parameters, as documented for the commands.
DEFAULTS: dict[str, dict[str, Any]] = {
    "lda": {"reg": "shrink", "lambda": "auto", "prob": False}, "multiclass_lda": {"reg": "shrink", "lambda": "auto"},
    "kernel_fda": {"reg": "shrink", "lambda": 1e-4, "kernel": "rbf", "gamma": None, "coef0": 1, "degree": 3},
    "logreg": {"reg": "logf", "lambda": 1.0, "correct_bias": True, "k": 5}, "svm": {"c": 1.0, "kernel": "rbf", "gamma": None, "coef0": 1, "degree": 2, "prob": False},
    "naive_bayes": {"prior": "equal"}, "ensemble": {"learner": "lda", "nlearners": 100, "nfeatures": 0.2, "nsamples": 0.8, "replace": True, "strategy": "dval"},
    "ridge": {"lambda": 1.0, "k": 5, "correlation_bound": None}, "kernel_ridge": {"lambda": 1.0, "kernel": "rbf", "gamma": None, "coef0": 1, "degree": 2, "correlation_bound": None},
}
LAMBDAS = np.logspace(-4, 3, 10)


def _scatter(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    classes = np.unique(y)
    means = np.stack([x[y == c].mean(0) for c in classes])
    centred = x - means[np.searchsorted(classes, y)]
    return centred.T @ centred, means, centred, classes


def _regularised(s: np.ndarray, reg: str, lam, centred: np.ndarray) -> np.ndarray:
    p = len(s)
    if reg == "shrink":
        lam = ledoit_wolf_lambda(centred) if lam == "auto" else lam
        return (1 - lam) * s + lam * np.eye(p) * np.trace(s) / p
    return s + lam * np.eye(p)


def _accuracy(predict):
    return lambda m, a, b: (predict(m, a)["pred"] == b).sum()


def _tuned(names, x, y, params, fit, predict):
    """``params`` with the values of lists in ``names`` that classify most inner test samples rightly."""
    grids = {k: list(params[k]) for k in names if isinstance(params.get(k), (list, tuple, np.ndarray))}
    return params | tune(grids, x, y, lambda a, b, q: fit(a, b, params | q), _accuracy(predict), params.get("k", 5)) if grids else params


def fit_lda(x, y, params):
    params = _tuned(("lambda",), x, y, params, fit_lda, predict_linear)
    s, means, centred, _ = _scatter(x, y)
    s = _regularised(s, params["reg"], params["lambda"], centred)
    w = np.linalg.solve(s, means[0] - means[1])
    model = {"w": w, "b": -w @ (means[0] + means[1]) / 2}
    if params.get("prob"):
        model |= {"means": means, "cov": s / len(x), "prior": np.array([(y == 1).mean(), (y == 2).mean()])}
    return model


def predict_linear(model, x):
    d = x @ model["w"] + model["b"]
    out = {"dval": d, "pred": np.where(d >= 0, 1, 2)}
    if "cov" in model:
        inv = np.linalg.inv(model["cov"])
        like = np.stack([np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, inv, x - m)) * p for m, p in zip(model["means"], model["prior"])])
        out["prob"] = like[0] / np.maximum(like.sum(0), 1e-300)
    return out


def fit_multiclass_lda(x, y, params):
    """Axes of the generalised eigenproblem of between and within scatter, scaled to unit within scatter."""
    s, means, centred, classes = _scatter(x, y)
    s = _regularised(s, params["reg"], params["lambda"], centred)
    n = np.array([(y == c).sum() for c in classes])
    d = (means - x.mean(0)) * np.sqrt(n)[:, None]
    root = np.linalg.inv(np.linalg.cholesky(s + 1e-12 * np.trace(s) / len(s) * np.eye(len(s))))
    _, v = np.linalg.eigh(root @ d.T @ d @ root.T)
    w = root.T @ v[:, ::-1][:, : len(classes) - 1]
    return {"axes": w, "centroids": means @ w, "classes": classes}


def predict_centroid(model, x, projected=None):
    z = x @ model["axes"] if projected is None else projected
    d = ((z[:, None] - model["centroids"][None]) ** 2).sum(2)
    e = np.exp(-(d - d.min(1, keepdims=True)) / 2)
    return {"pred": model["classes"][d.argmin(1)], "prob_all": e / e.sum(1, keepdims=True)}


_kernel = lowrank.kernel


def _one_hot(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    classes = np.unique(y)
    return classes, (y[:, None] == classes).astype(float)


def _kernel_fda(basis, params, classes, gg, sums, n):
    """The discriminant of K = G G' from G'G and the sums of G by class (columns).

    Within and between scatter are G S G' and G D D' G', so axes are G M q with M = ((1 - l) S G'G + t I)^-1 D and
    unit eigenvectors q of D' G'G M: no matrix has a side of samples.
    """
    on = n > 0
    classes, sums, n = classes[on], sums[:, on], n[on]
    means, mean = sums / n, sums.sum(1) / n.sum()
    s = gg - (means * n) @ means.T
    lam, trace = params["lambda"], float((s * gg).sum())
    a, shift = ((1 - lam) * s, lam * trace / n.sum()) if params["reg"] == "shrink" else (s, lam)
    d = (means - mean[:, None]) * np.sqrt(n)
    m = np.linalg.solve(a @ gg + shift * np.eye(len(gg)), d)
    inner = d.T @ gg @ m
    mu, q = np.linalg.eigh((inner + inner.T) / 2)
    mu, q = mu[::-1][: len(classes) - 1], q[:, ::-1][:, : len(classes) - 1]
    w = gg @ m @ (q / np.sqrt(np.maximum(mu, 1e-300)))
    return basis.predictor(w) | {"centroids": means.T @ w, "classes": classes}


def fit_kernel_fda(x, y, params):
    return dict(folds_kernel_fda(x, y, np.zeros(len(y), int), params, ()))[None]


def folds_kernel_fda(x, y, fold, params, wanted):
    """(fold, model without its samples); without folds wanted, (None, model of all samples)."""
    classes, hot = _one_hot(y)
    basis, by = lowrank.fold_moments(x, hot, fold, params)
    for f, (gg, sums, n) in _left_out(by, wanted):
        yield f, _kernel_fda(basis, params, classes, gg, sums, n)


def _left_out(by, wanted):
    for f in wanted or (None,):
        rest = [v for k, v in by.items() if k != f]
        yield f, [sum(parts) for parts in zip(*rest)]


def fit_logreg(x, y, params):
    """logF(1,1) pseudo-rows or an L2 penalty; rows weighted so that both classes count alike."""
    if params["reg"] == "l2" and isinstance(params["lambda"], (str, list, tuple, np.ndarray)):
        grid = LAMBDAS if isinstance(params["lambda"], str) else params["lambda"]
        acc = lambda m, a, b: (predict_linear(m, a)["pred"] == b).sum()
        params = params | tune({"lambda": list(grid)}, x, y, lambda a, b, q: fit_logreg(a, b, params | q), acc, params["k"])
    t = np.where(y == 1, 1.0, -1.0)
    n, p = x.shape
    bias = np.full((n, 1), 100.0)
    z, weight = np.hstack([x, bias]), np.ones(n)
    if params["reg"] == "logf":
        pseudo = np.hstack([np.eye(p), np.zeros((p, 1))])
        z, t, weight = np.vstack([z, pseudo, pseudo]), np.concatenate([t, np.ones(p), -np.ones(p)]), np.concatenate([weight, np.full(2 * p, 0.5)])
        lam = 0.0
    else:
        lam = float(params["lambda"])
    if params["correct_bias"]:
        share = (t > 0).mean()
        weight = weight * np.where(t > 0, 0.5 / share, 0.5 / (1 - share))
    ridge = np.append(np.full(p, lam), 0.0)

    def fun(w):
        m = t * (z @ w)
        s = 1 / (1 + np.exp(np.clip(m, -500, 500)))
        grad = -(z * (weight * t * s)[:, None]).sum(0) + ridge * w
        return (weight * np.logaddexp(0, -m)).sum() + (ridge * w * w).sum() / 2, grad, (z * (weight * s * (1 - s))[:, None]).T @ z + np.diag(ridge)

    w, _ = trust_newton(fun, np.zeros(p + 1))
    return {"w": w[:p], "b": w[p] * 100.0, "logistic": True}


def predict_logreg(model, x):
    out = predict_linear(model, x)
    return out | {"prob": 1 / (1 + np.exp(-np.clip(out["dval"], -500, 500)))}


def fit_svm(x, y, params):
    """L1-loss dual with a constant added to the kernel for the bias, on the columns of the factored kernel. Lists are tuned."""
    params = _tuned(("c", "gamma", "coef0", "degree"), x, y, params | {"prob": False}, fit_svm, predict_svm) | {"prob": params.get("prob")}
    t = np.where(y == 1, 1.0, -1.0)
    basis = lowrank.Basis(x, params)
    g = np.concatenate([part for _, part in basis.blocks(x)])
    v = np.hstack([g, np.ones((len(g), 1))]) * t[:, None]
    del g
    w = v.T @ factored_dual(v, params["c"])[0]
    if params["kernel"] == "linear":
        model = {"w": w[:-1], "b": float(w[-1])}
    else:
        model = basis.predictor(w[:-1]) | {"b": float(w[-1])}
    if params.get("prob"):
        model["platt"] = platt(predict_svm(model, x)["dval"], y == 1)
    return model


def predict_svm(model, x):
    d = x @ model["w"] + model["b"] if "w" in model else lowrank.project(model, x) + model["b"]
    out = {"dval": d, "pred": np.where(d >= 0, 1, 2)}
    if "platt" in model:
        out["prob"] = 1 / (1 + np.exp(np.clip(model["platt"][0] * d + model["platt"][1], -500, 500)))
    return out


def fit_naive_bayes(x, y, params):
    classes = np.unique(y)
    prior = np.array([(y == c).mean() for c in classes]) if params["prior"] == "data" else np.full(len(classes), 1 / len(classes))
    return {"classes": classes, "mu": np.stack([x[y == c].mean(0) for c in classes]), "va": np.stack([x[y == c].var(0, ddof=1) for c in classes]), "prior": prior}


def predict_naive_bayes(model, x):
    s = np.stack([-((x - m) ** 2 / (2 * v)).sum(1) + np.log(p) for m, v, p in zip(model["mu"], model["va"], model["prior"])], 1)
    e = np.exp(s - s.max(1, keepdims=True))
    out = {"pred": model["classes"][s.argmax(1)], "prob_all": e / e.sum(1, keepdims=True)}
    return out | ({"dval": s[:, 0] - s[:, 1], "prob": out["prob_all"][:, 0]} if len(model["classes"]) == 2 else {})


def fit_ensemble(x, y, params):
    """Learners on random features and samples, each class drawn apart."""
    rng = np.random.default_rng(params.get("seed", 0))
    count = lambda v, n: max(1, int(round(v * n)) if v < 1 else int(v))
    learner = params["learner"]
    own = DEFAULTS.get(learner, {}) | params.get("learner_param", {})
    learners = []
    for _ in range(params["nlearners"]):
        f = rng.choice(x.shape[1], min(count(params["nfeatures"], x.shape[1]), x.shape[1]), replace=False)
        at = np.concatenate([rng.choice(i := np.flatnonzero(y == c), min(count(params["nsamples"], len(i)), len(i)) if not params["replace"] else count(params["nsamples"], len(i)), replace=params["replace"]) for c in np.unique(y)])
        learners.append((f, MODELS[learner][0](x[np.ix_(at, f)], y[at], own)))
    return {"learners": learners, "learner": learner, "strategy": params["strategy"], "classes": np.unique(y)}


def predict_ensemble(model, x):
    outs = [MODELS[model["learner"]][1](m, x[:, f]) for f, m in model["learners"]]
    if model["strategy"] == "dval" and all("dval" in o for o in outs):
        d = sum(o["dval"] for o in outs)
        return {"dval": d, "pred": np.where(d >= 0, 1, 2)}
    votes = np.stack([(np.stack([o["pred"] for o in outs]) == c).sum(0) for c in model["classes"]], 1)
    return {"pred": model["classes"][votes.argmax(1)]}


def _bound(w: np.ndarray, pred: np.ndarray, y: np.ndarray, bound: float | None) -> np.ndarray | float:
    """Factor that brings the correlation of y with the residual of the scaled prediction to ``bound`` (per response)."""
    if bound is None:
        return 1.0
    y2, p2 = y - y.mean(0), pred - pred.mean(0)
    yy, yp, pp = (y2 * y2).sum(0), (y2 * p2).sum(0), (p2 * p2).sum(0)
    # corr(y, y - f p) = bound:  (yy - f yp)^2 = bound^2 yy (yy - 2 f yp + f^2 pp), the smaller root above 1
    a, b, c = yp**2 - bound**2 * yy * pp, -2 * yy * yp * (1 - bound**2), yy**2 * (1 - bound**2)
    root = np.sqrt(np.maximum(b * b - 4 * a * c, 0))
    lo, hi = (-b - root) / (2 * a), (-b + root) / (2 * a)
    f = np.where(np.minimum(lo, hi) > 0, np.minimum(lo, hi), np.maximum(lo, hi))
    start = (yy - yp) / np.sqrt(np.maximum(yy * (yy - 2 * yp + pp), 1e-300))
    return np.where(np.abs(start) <= bound, 1.0, f)


def fit_ridge(x, y, params):
    if not np.isscalar(params["lambda"]) or params["lambda"] == "auto":
        grid = LAMBDAS if isinstance(params["lambda"], str) else params["lambda"]
        err = lambda m, a, b: -np.abs(predict_ridge(m, a)["pred"] - b).mean()
        params = params | tune({"lambda": list(grid)}, x, y, lambda a, b, q: fit_ridge(a, b, params | q), err, params["k"], stratify=False)
    m, my = x.mean(0), y.mean(0)
    z, lam = x - m, float(params["lambda"])
    w = np.linalg.lstsq(z.T @ z + lam * np.eye(x.shape[1]), z.T @ (y - my), rcond=None)[0] if len(x) >= x.shape[1] else z.T @ np.linalg.lstsq(z @ z.T + lam * np.eye(len(x)), y - my, rcond=None)[0]
    w = w * _bound(w, z @ w, y, params.get("correlation_bound"))
    return {"w": w, "b": my - m @ w}


def predict_ridge(model, x):
    return {"pred": x @ model["w"] + model["b"]}


def fit_kernel_ridge(x, y, params):
    grids = {k: list(v) for k, v in params.items() if k in ("lambda", "gamma", "coef0", "degree") and isinstance(v, (list, tuple, np.ndarray))}
    if grids:
        err = lambda m, a, b: -np.abs(predict_kernel_ridge(m, a)["pred"] - b).mean()
        params = params | tune(grids, x, y, lambda a, b, q: fit_kernel_ridge(a, b, params | q), err, stratify=False)
    return dict(folds_kernel_ridge(x, y, np.zeros(len(y), int), params, ()))[None]


def folds_kernel_ridge(x, y, fold, params, wanted):
    """K alpha of (K + l I) alpha = y is G (G'G + l I)^-1 G' y."""
    one = y.reshape(len(y), -1)
    basis, by = lowrank.fold_moments(x, one, fold, params)
    for f, (gg, gy, _) in _left_out(by, wanted):
        w = np.linalg.solve(gg + params["lambda"] * np.eye(len(gg)), gy)
        w = w if y.ndim > 1 else w[:, 0]
        model = basis.predictor(w)
        if params.get("correlation_bound") is not None:
            train = fold != f if f is not None else np.ones(len(y), bool)
            model["coef"] = model["coef"] * _bound(w, lowrank.project(model, x[train]), y[train], params["correlation_bound"])
        yield f, model


def predict_kernel_ridge(model, x):
    return {"pred": lowrank.project(model, x)}


MODELS: dict[str, tuple[Callable, Callable]] = {
    "lda": (fit_lda, predict_linear), "multiclass_lda": (fit_multiclass_lda, predict_centroid),
    "kernel_fda": (fit_kernel_fda, lambda m, x: predict_centroid(m, x, lowrank.project(m, x))),
    "logreg": (fit_logreg, predict_logreg), "svm": (fit_svm, predict_svm), "naive_bayes": (fit_naive_bayes, predict_naive_bayes),
    "ensemble": (fit_ensemble, predict_ensemble), "ridge": (fit_ridge, predict_ridge), "kernel_ridge": (fit_kernel_ridge, predict_kernel_ridge),
}
#: Models that are fitted to all folds of a group at once: ``folds(x, y, fold, params, wanted) -> (fold, model)``.
FOLDS: dict[str, Callable] = {"kernel_fda": folds_kernel_fda, "kernel_ridge": folds_kernel_ridge}
REGRESSION = {"ridge", "kernel_ridge"}
BINARY = {"lda", "logreg", "svm"}
#: Types of the external solvers that a model here carries out: (model, parameters).
SOLVERS: dict[str, dict[int, tuple[str, dict[str, Any]]]] = {
    "libsvm": {0: ("svm", {}), 3: ("kernel_ridge", {})},
    "liblinear": {0: ("logreg", {"reg": "l2"}), 7: ("logreg", {"reg": "l2"}), **{k: ("svm", {"kernel": "linear"}) for k in (1, 2, 3)}},
}


def solver_model(solver: str, options: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """(model, parameters) for the options of an external solver: its type, cost, kernel and kernel parameters.

    An L2 penalty is one over the cost. Support vector regression (type 3) is carried out as kernel ridge regression.
    """
    kind = options.get("svm_type" if solver == "libsvm" else "type", 0)
    if kind not in SOLVERS[solver]:
        raise ValueError(f"{solver} type {kind} has no model here")
    model, params = SOLVERS[solver][kind]
    cost = options.get("cost", 1)
    params = params | {k: options[k] for k in ("kernel", "gamma", "coef0", "degree") if solver == "libsvm" and options.get(k) is not None}
    return model, params | ({"c": cost} if model == "svm" else {"lambda": 1 / cost} | ({"correct_bias": False} if model == "logreg" else {}))


def register_model(name: str, fit: Callable, predict: Callable, defaults: dict[str, Any] | None = None, regression: bool = False) -> None:
    """Make a user's model known by name."""
    MODELS[name] = (fit, predict)
    FOLDS.pop(name, None)
    DEFAULTS[name] = defaults or {}
    if regression:
        REGRESSION.add(name)
