"""Numerical solvers used inside one group: damped Newton, dual coordinate descent and interior points, Platt scaling, grid tuning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np


def trust_newton(fun: Callable, w: np.ndarray, tol: float = 1e-8, max_iter: int = 100) -> tuple[np.ndarray, int]:
    """Minimise ``fun(w) -> (value, gradient, hessian)`` by Newton steps inside a trust radius that follows the model's
    agreement with the function."""
    value, grad, hess = fun(w)
    damping = 1e-6
    for step in range(1, max_iter + 1):
        if np.linalg.norm(grad) < tol * max(1, np.linalg.norm(w)):
            return w, step
        while True:
            move = -np.linalg.lstsq(hess + damping * np.eye(len(w)), grad, rcond=None)[0]
            trial = fun(w + move)
            predicted = -(grad @ move + move @ hess @ move / 2)
            gain = (value - trial[0]) / predicted if predicted > 0 else -1
            if gain > 1e-4:
                damping = max(damping / (10 if gain > 0.75 else 1), 1e-12)
                break
            damping = max(damping, 1e-10) * 10
            if damping > 1e12:
                return w, step
        w = w + move
        value, grad, hess = trial
    return w, max_iter


def dual_descent(q: np.ndarray, upper: np.ndarray | float, tol: float = 1e-4, max_sweeps: int = 1000, seed: int = 0) -> tuple[np.ndarray, int]:
    """max sum(a) - a'Qa/2 with 0 <= a <= upper by coordinate descent over a shuffled order, settled bounds left out."""
    n = len(q)
    upper = np.broadcast_to(np.asarray(upper, float), (n,))
    a, g, rng, active = np.zeros(n), -np.ones(n), np.random.default_rng(seed), np.arange(n)
    for sweep in range(1, max_sweeps + 1):
        rng.shuffle(active)
        worst = 0.0
        for i in active:
            pg = min(g[i], 0) if a[i] <= 0 else max(g[i], 0) if a[i] >= upper[i] else g[i]
            worst = max(worst, abs(pg))
            if abs(pg) > 1e-12:
                new = min(max(a[i] - g[i] / q[i, i], 0), upper[i])
                g += q[:, i] * (new - a[i])
                a[i] = new
        if worst < tol:
            if len(active) == n:
                return a, sweep
            active = np.arange(n)
        elif sweep % 5 == 0:
            free = ~(((a <= 0) & (g > worst)) | ((a >= upper) & (g < -worst)))
            active = np.flatnonzero(free)
    return a, max_sweeps


def factored_dual(v: np.ndarray, upper: np.ndarray | float, ridge: float = 1e-9, tol: float = 1e-10, max_iter: int = 200) -> tuple[np.ndarray, int]:
    """max sum(a) - a'Qa/2 with 0 <= a <= upper for Q = V V' + ridge I: a primal-dual interior point method (predictor
    and corrector) whose systems have the columns of V as their side, so that no n x n matrix is made. It ends when the
    duality gap is ``tol`` of the objective; at a limit reached before that it raises."""
    n, r = v.shape
    upper = np.broadcast_to(np.asarray(upper, float), (n,))
    a, s, u = upper / 2, np.ones(n), np.ones(n)
    for step in range(1, max_iter + 1):
        t = upper - a
        qa = v @ (v.T @ a) + ridge * a
        dual = qa - 1 - s + u
        gap = s @ a + u @ t
        if gap <= tol * max(1.0, abs(a.sum() - a @ qa / 2)) and np.abs(dual).max() <= 1e-7:
            return a, step
        d = ridge + s / a + u / t
        vd = v / d[:, None]
        inner = np.linalg.cholesky(np.eye(r) + v.T @ vd)

        def solve(b):
            x = b / d
            x = x - vd @ np.linalg.solve(inner.T, np.linalg.solve(inner, v.T @ x))
            left = b - d * x - v @ (v.T @ x)  # one refinement
            y = left / d
            return x + y - vd @ np.linalg.solve(inner.T, np.linalg.solve(inner, v.T @ y))

        def move(low, high):
            """Step for wanted products ``low`` of a and s, and ``high`` of upper - a and u."""
            da = solve(-dual + (low - a * s) / a - (high - t * u) / t)
            return da, (low - a * s) / a - s / a * da, (high - t * u) / t + u / t * da

        def reach(da, ds, du):
            low = [(-x[k] / dx[k]).min() for x, dx in ((a, da), (t, -da), (s, ds), (u, du)) if (k := dx < 0).any()]
            return min([1.0, *low])

        zero = np.zeros(n)
        da, ds, du = move(zero, zero)
        f = reach(da, ds, du)
        mu = gap / (2 * n)
        after = ((a + f * da) @ (s + f * ds) + (t - f * da) @ (u + f * du)) / (2 * n)
        centre = (after / mu) ** 3 * mu
        da, ds, du = move(centre - da * ds, centre + da * du)
        f = 0.995 * reach(da, ds, du)
        a, s, u = a + f * da, s + f * ds, u + f * du
    raise ArithmeticError(f"no solution within {max_iter} steps")


def platt(dval: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """(A, B) of P(class 1) = 1 / (1 + exp(A * dval + B)), with smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def fun(w):
        z = w[0] * dval + w[1]
        p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
        x = np.stack([dval, np.ones_like(dval)], 1)
        value = (t * z + np.logaddexp(0, -z)).sum()
        return value, x.T @ (t - p), (x * (p * (1 - p))[:, None]).T @ x + 1e-12 * np.eye(2)

    w, _ = trust_newton(fun, np.array([0.0, np.log((n0 + 1) / (n1 + 1))]))
    return float(w[0]), float(w[1])


def inner_folds(n: int, k: int, y: np.ndarray | None = None) -> np.ndarray:
    """Fold numbers 0..k-1, in turn within classes if labels are given."""
    out = np.zeros(n, int)
    for c in np.unique(y) if y is not None else [None]:
        at = np.flatnonzero(y == c) if y is not None else np.arange(n)
        out[at] = np.arange(len(at)) % k
    return out


def tune(values: dict[str, Sequence], x: np.ndarray, y: np.ndarray, fit: Callable, evaluate: Callable, k: int = 5, stratify: bool = True) -> dict:
    """The combination with the largest sum of ``evaluate(model, x, y)`` over inner folds; the first among equals."""
    folds = inner_folds(len(x), k, y if stratify else None)
    best, best_score = {}, -np.inf
    for combo in product(*values.values()):
        params = dict(zip(values, combo))
        score = sum(evaluate(fit(x[folds != f], y[folds != f], params), x[folds == f], y[folds == f]) for f in range(k))
        if score > best_score:
            best, best_score = params, score
    return best


def ledoit_wolf_lambda(x: np.ndarray) -> float:
    """Shrinkage of rows centred by column towards the scaled identity.

    With more features than rows the same number comes from the Gram matrix: the squared entries of rows' outer products
    sum to squared norms, and covariance and Gram matrix have the same trace and norm.
    """
    n, p = x.shape
    x = x - x.mean(0)
    gram = x @ x.T if p > n else x.T @ x
    norms = (x * x).sum(1)
    squares, trace = (gram**2).sum() / n**2, norms.sum() / n
    phi, gamma = (norms**2).sum() / n - squares, squares - trace**2 / p
    return float(np.clip(phi / gamma / n, 0, 1)) if gamma > 0 else 1.0
