"""Spatial filters fitted to training arrays (n x channels x times, or n x features): PCA, CSP, SSD, noise normalisation."""

from __future__ import annotations

import numpy as np

from .solvers import ledoit_wolf_lambda


def generalised_eigh(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a w = e b w, largest first, w'bw = 1."""
    root = np.linalg.inv(np.linalg.cholesky(b + 1e-12 * np.trace(b) / len(b) * np.eye(len(b))))
    e, v = np.linalg.eigh(root @ a @ root.T)
    return e[::-1], (root.T @ v)[:, ::-1]


def mean_covariance(x: np.ndarray, by_trace: bool = False) -> np.ndarray:
    """Mean over samples of channel covariances (of rows for 2-D input)."""
    if x.ndim == 2:
        return np.atleast_2d(np.cov(x, rowvar=False))
    c = x - x.mean(2, keepdims=True)
    s = np.einsum("nct,ndt->ncd", c, c) / (x.shape[2] - 1)
    return (s / np.trace(s, axis1=1, axis2=2)[:, None, None]).mean(0) if by_trace else s.mean(0)


def project(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w if x.ndim == 2 else np.einsum("nct,ck->nkt", x, w)


def fit_pca(x: np.ndarray, n: int = 20, whiten: bool = True) -> np.ndarray:
    """Leading eigenvectors, scaled to unit variance with ``whiten``; data are not centred when projected."""
    e, v = np.linalg.eigh(mean_covariance(x))
    e, v = e[::-1][:n], v[:, ::-1][:, :n]
    return v / np.sqrt(np.maximum(e, 1e-300)) if whiten else v


def fit_csp(x: np.ndarray, y: np.ndarray, n: int = 1, lam: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(filters, patterns): n leading and n trailing filters of class 1 against class 2."""
    c1, c2 = (mean_covariance(x[y == c], True) + lam * np.eye(x.shape[1]) for c in (1, 2))
    _, w = generalised_eigh(c1, c2)
    pick = [*range(n), *range(w.shape[1] - n, w.shape[1])]
    return w[:, pick], np.linalg.inv(w).T[:, pick]


def log_variance(z: np.ndarray) -> np.ndarray:
    return np.log(z.var(axis=2, ddof=1))


def fit_ssd(signal: np.ndarray, noise: np.ndarray, n: int = 5, lam: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(filters, patterns) with the largest ratio of signal to noise."""
    a, b = (mean_covariance(x, True) + lam * np.eye(x.shape[1]) for x in (signal, noise))
    _, w = generalised_eigh(a, b)
    return w[:, :n], np.linalg.inv(w).T[:, :n]


def inverse_root(c: np.ndarray) -> np.ndarray:
    e, v = np.linalg.eigh(c)
    return (v / np.sqrt(np.maximum(e, 1e-12 * e.max()))) @ v.T


def fit_mmn(x: np.ndarray, lam: float | str = "auto") -> np.ndarray:
    """Noise normalisation: inverse root of the shrunk covariance; of each sample and averaged for 3-D input."""
    def shrunk(z: np.ndarray) -> np.ndarray:
        c = np.atleast_2d(np.cov(z, rowvar=False))
        k = (ledoit_wolf_lambda(z) if len(z) > 2 else 0.01) if lam == "auto" else lam
        return (1 - k) * c + k * np.eye(len(c)) * np.trace(c) / len(c)

    return inverse_root(shrunk(x)) if x.ndim == 2 else np.mean([inverse_root(shrunk(s.T)) for s in x], axis=0)
