"""Nested stages of the array engine: fitted on training samples, applied to any others.

A stage is ``stage(train, labels, params) -> (train, labels, apply)`` and ``apply(test, labels, rows) -> (test, labels,
rows)``; ``rows`` numbers the samples that the test rows stand for. ``apply`` is kept with the model, so a model is fitted
once whatever it is tested on. Samples are rows of features; stages of oscillations read them as ``channels`` blocks of
equal length (channels x times).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np

from ..operators import spatial
from ..sources.simulate import bandpass

Apply = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
ARRAY_STAGES: dict[str, Callable[[np.ndarray, np.ndarray, dict], tuple[np.ndarray, np.ndarray, Apply]]] = {}


def register_array_stage(name: str, stage: Callable) -> None:
    """Make a user's nested stage known by name."""
    ARRAY_STAGES[name] = stage


def _same(b, y, rows):
    return b, y, rows


def _affine(shift, scale, b, y, rows):
    return (b - shift) / scale, y, rows


def _demean(a, y, p):
    m = a.mean(0)
    return a - m, y, partial(_affine, m, 1.0)


def _zscore(a, y, p):
    m, s = a.mean(0), a.std(0, ddof=1)
    return (a - m) / s, y, partial(_affine, m, s)


def _undersample(a, y, p):
    rng = np.random.default_rng(p.get("seed", 0))
    n = min(np.bincount(y)[1:][np.bincount(y)[1:] > 0])
    at = np.sort(np.concatenate([rng.choice(np.flatnonzero(y == c), n, replace=False) for c in np.unique(y)]))
    return a[at], y[at], _same


def _oversample(a, y, p):
    rng = np.random.default_rng(p.get("seed", 0))
    n = np.bincount(y).max()
    at = np.concatenate([np.concatenate([i := np.flatnonzero(y == c), rng.choice(i, n - len(i))]) for c in np.unique(y)])
    return a[at], y[at], _same


def _project(w, b, y, rows):
    return spatial.project(w, b), y, rows


def _filtered(w, a, y):
    return spatial.project(w, a), y, partial(_project, w)


def _averages(size, seed, a, y, rows):
    """Means of shuffled groups of ``size`` samples of one class; leftovers go. The first sample of a group names it."""
    rng, out = np.random.default_rng(seed), []
    for c in np.unique(y):
        at = rng.permutation(np.flatnonzero(y == c))
        out += list(at[: len(at) // size * size].reshape(-1, size))
    groups = np.array(out, int).reshape(-1, size)
    return a[groups].mean(1), y[groups[:, 0]], rows[groups.min(1)]


def _average_samples(a, y, p):
    apply = partial(_averages, p.get("group_size", 5), p.get("seed", 0))
    a, y, _ = apply(a, y, np.arange(len(a)))
    return a, y, apply


def _fill(values, b, y, rows):
    bad = ~np.isfinite(b)
    return np.where(bad, np.broadcast_to(values, b.shape), b), y, rows


def _along(method, b, y, rows):
    """Forward, backward or nearest filling along the features (a series), sample by sample; what nothing fills is NaN."""
    ok, at = np.isfinite(b), np.arange(b.shape[1])
    prev = np.maximum.accumulate(np.where(ok, at, -1), 1)
    nxt = np.minimum.accumulate(np.where(ok, at, b.shape[1])[:, ::-1], 1)[:, ::-1]
    near = (prev >= 0) & ((nxt == b.shape[1]) | (at - prev <= nxt - at))
    pick = {"forward": prev, "backward": nxt, "nearest": np.where(near, prev, nxt)}[method]
    found = (pick >= 0) & (pick < b.shape[1])
    return np.where(found, np.take_along_axis(b, np.where(found, pick, 0), 1), np.nan), y, rows


def _impute(a, y, p):
    method = p.get("method", "forward")
    if method == "mean":  # of the training samples, feature by feature
        apply = partial(_fill, np.nanmean(np.where(np.isfinite(a), a, np.nan), 0))
    else:
        apply = partial(_fill, float(p.get("fill", 0.0))) if method == "fill" else partial(_along, method)
    return apply(a, y, np.arange(len(a)))[0], y, apply


def _cube(p, a):
    return a.reshape(len(a), p["channels"], -1)


def _components(p, w, b, y, rows):
    z = spatial.project(w, _cube(p, b))
    if p.get("calculate_variance", False):
        z = z.var(axis=2, ddof=1)
        z = np.log(z) if p.get("calculate_log", True) else z
    return z.reshape(len(z), -1), y, rows


def _csp(a, y, p):
    apply = partial(_components, p, spatial.fit_csp(_cube(p, a), y, p.get("n", 1), p.get("lambda", 0.0))[0])
    return apply(a, y, np.arange(len(a)))[0], y, apply


def _ssd(a, y, p):
    """Signal: the band ``signal`` (low, high); noise: the band ``noise`` around it less the signal's own flanks."""
    x, fs, (low, high), (first, last) = _cube(p, a), p["fs"], p["signal"], p["noise"]
    gap = p.get("gap", 1.0)
    noise = bandpass(x, fs, first, last) - bandpass(x, fs, low - gap, high + gap)
    apply = partial(_components, p, spatial.fit_ssd(bandpass(x, fs, low, high), noise, p.get("n", 5), p.get("lambda", 0.0))[0])
    return apply(a, y, np.arange(len(a)))[0], y, apply


for _name, _stage in (
    ("demean", _demean), ("zscore", _zscore), ("undersample", _undersample), ("oversample", _oversample), ("average_samples", _average_samples),
    ("impute_nan", _impute), ("csp", _csp), ("ssd", _ssd),
    ("pca", lambda a, y, p: _filtered(spatial.fit_pca(a, min(p.get("n", 20), a.shape[1]), p.get("normalize", True)), a, y)),
    ("mmn", lambda a, y, p: _filtered(spatial.fit_mmn(a, p.get("lambda", "auto")), a, y)),
):
    register_array_stage(_name, _stage)
