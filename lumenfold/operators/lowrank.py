"""Kernels in factored form: K = G G' with G of as many columns as the kernel's numerical rank, never n x n.

The linear kernel has G = x. For the others G comes from a pivoted Cholesky factorisation that reads the samples in
blocks: within a block the sample with the largest residual becomes a pivot until none is above ``TOL`` of the largest
diagonal entry, so the bound holds at every sample whatever their order; residuals never grow when pivots are added.
A kernel that is not positive semi-definite has no such form and is refused.
The rank is not capped: a kernel of full rank gets as many pivots as samples, and the same model as from the whole matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.kernels import ARRAY_KERNELS

TOL = 1e-10
BLOCK = 2048


def kernel(params: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ARRAY_KERNELS[params["kernel"]](a, b, **{k: params.get(k) for k in ("gamma", "coef0", "degree")})


def _diagonal(params: dict, x: np.ndarray) -> np.ndarray:
    return np.array([kernel(params, v[None], v[None])[0, 0] for v in x]) if params["kernel"] != "rbf" else np.ones(len(x))


class Basis:
    """Features of a kernel: ``basis(x) @ basis(z).T`` is the kernel of x and z for samples near those it was made of."""

    def __init__(self, x: np.ndarray, params: dict):
        self.params, self.linear = params, params["kernel"] == "linear"
        self.pivots, self.root = x[:0], np.zeros((0, 0))
        if self.linear:
            return
        top = max((float(_diagonal(params, b).max()) for b in np.array_split(x, max(len(x) // BLOCK, 1)) if len(b)), default=0.0)
        for at in range(0, len(x), BLOCK):
            self._extend(x[at : at + BLOCK], TOL * top)

    def _extend(self, b: np.ndarray, least: float) -> None:
        g = self(b)
        left = _diagonal(self.params, b) - (g * g).sum(1)
        picked: list[int] = []
        rows = np.empty((len(b), 0))  # columns of the new pivots
        while left[i := int(left.argmax())] > least:
            if len(picked) == rows.shape[1]:
                rows = np.hstack([rows, np.empty((len(b), 64))])
            n = len(picked)
            col = kernel(self.params, b, b[i : i + 1])[:, 0] - g @ g[i] - rows[:, :n] @ rows[i, :n]
            rows[:, n] = col / np.sqrt(left[i])
            left -= rows[:, n] ** 2
            left[i] = 0.0
            picked.append(i)
        if len(b) and not left.min() > -1e3 * least:
            raise ValueError(f"kernel {self.params['kernel']} is not positive semi-definite on these samples")
        if picked:
            # G of a new sample is K(sample, pivots) times the inverse of the pivots' triangle, kept transposed
            n, m = len(self.pivots), len(picked)
            own = np.linalg.inv(np.tril(rows[picked, :m]))
            grown = np.zeros((n + m, n + m))
            grown[:n, :n], grown[n:, n:] = self.root, own.T
            grown[:n, n:] = -self.root @ g[picked].T @ own.T
            self.pivots, self.root = np.vstack([self.pivots, b[picked]]), grown

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x if self.linear else kernel(self.params, x, self.pivots) @ self.root

    def blocks(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(x), BLOCK):
            yield slice(at, at + BLOCK), self(x[at : at + BLOCK])

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Coefficients of the pivots' kernel columns (of the features for the linear kernel)."""
        return w if self.linear else self.root @ w

    def predictor(self, w: np.ndarray) -> dict:
        """What ``project`` needs to give G w of new samples."""
        return {"coef": self.weights(w), "x": self.pivots, "params": self.params, "linear": self.linear}


def project(model: dict, x: np.ndarray) -> np.ndarray:
    if model["linear"]:
        return x @ model["coef"]
    step = max(1, min(BLOCK * 4, 8_000_000 // max(len(model["x"]), 1)))
    parts = [kernel(model["params"], x[at : at + step], model["x"]) @ model["coef"] for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, *model["coef"].shape[1:]))


def moments(basis: Basis, x: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(G'G, G' sums) over the samples, block by block."""
    c = s = None
    for at, g in basis.blocks(x):
        gg, gs = g.T @ g, g.T @ sums[at]
        c, s = (gg, gs) if c is None else (c + gg, s + gs)
    return c, s


def fold_moments(x: np.ndarray, sums: np.ndarray, fold: np.ndarray, params: dict) -> tuple[Basis, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(basis, (G'G, G' sums, sum of sums) by fold): one factorisation for all folds, each sample read once."""
    basis = Basis(x, params)
    return basis, {int(f): (*moments(basis, x[fold == f], sums[fold == f]), sums[fold == f].sum(0)) for f in np.unique(fold)}
