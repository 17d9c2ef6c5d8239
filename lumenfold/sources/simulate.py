"""Simulated data. Closed forms run as DataFrame expressions; draws that need matrices run in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, x: np.ndarray, y: np.ndarray, label: str = "clabel") -> DataFrame:
    kind = "INT" if label == "clabel" else "DOUBLE"
    data = [(i, int(c) if kind == "INT" else float(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, f"sample_id BIGINT, {label} {kind}, features ARRAY<DOUBLE>")


def class_sizes(n: int, classes: int, prop: list[float] | None = None) -> list[int]:
    share = prop or [1 / classes] * classes
    sizes = [round(n * p) for p in share]
    sizes[-1] += n - sum(sizes)
    return sizes


def gaussian_arrays(n: int, p: int, classes: int = 2, prop: list[float] | None = None, scale: float = 1.0, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Centroids on the unit sphere, one Wishart covariance for each class."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(classes, p))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    xs, ys = [], []
    for c, size in enumerate(class_sizes(n, classes, prop)):
        root = rng.normal(size=(2 * p, p)) * np.sqrt(scale / (2 * p))
        xs.append(centre[c] + rng.normal(size=(size, 2 * p)) @ root)
        ys += [c + 1] * size
    return np.concatenate(xs), np.array(ys)


def gaussian(spark: SparkSession, n: int, p: int, classes: int = 2, prop: list[float] | None = None, scale: float = 1.0, seed: int = 42) -> DataFrame:
    return _rows(spark, *gaussian_arrays(n, p, classes, prop, scale, seed))


def spiral(spark: SparkSession, n: int, revolutions: float = 2, classes: int = 2, scale: float = 0.001, seed: int = 42) -> DataFrame:
    """Classes on interleaved spiral arms."""
    per = -(-n // classes)
    arm = (F.floor(F.col("id") / per)).cast("int")
    r = (F.col("id") % per + 1) / per
    angle = r * revolutions * 2 * np.pi + arm * 2 * np.pi / classes
    return spark.range(n).select(
        F.col("id").alias("sample_id"), (arm + 1).alias("clabel"),
        F.array(r * F.cos(angle) + F.randn(seed) * scale, r * F.sin(angle) + F.randn(seed + 1) * scale).alias("features"),
    )


def radial(spark: SparkSession, n: int, prop: float = 0.5, separation: float = 0.5, seed: int = 42) -> DataFrame:
    """A disc of radius 1 and a ring ``separation`` outside it, both of even density."""
    inner = F.col("id") < int(round(n * prop))
    lo, hi = 1 + separation, 2 + separation
    r = F.when(inner, F.sqrt(F.rand(seed))).otherwise(F.sqrt(F.rand(seed) * (hi**2 - lo**2) + lo**2))
    a = F.rand(seed + 1) * 2 * np.pi
    return spark.range(n).select(F.col("id").alias("sample_id"), F.when(inner, 1).otherwise(2).alias("clabel"), r.alias("r"), a.alias("a")).select(
        "sample_id", "clabel", F.array(F.col("r") * F.cos("a"), F.col("r") * F.sin("a")).alias("features")
    )


def checkerboard(spark: SparkSession, n: int, checkers: int = 3, classes: int = 2, scale: float = 1.0, seed: int = 42) -> DataFrame:
    """Even draws over a board of checkers x checkers fields, classes in turn along the diagonals."""
    d = spark.range(n).select(F.col("id").alias("sample_id"), (F.rand(seed) * checkers).alias("u"), (F.rand(seed + 1) * checkers).alias("v"))
    return d.select("sample_id", ((F.floor("u") + F.floor("v")) % classes + 1).cast("int").alias("clabel"), F.array(F.col("u") * scale, F.col("v") * scale).alias("features"))


def regression(spark: SparkSession, kind: str, n: int, p: int = 1, scale: float = 0.1, seed: int = 42) -> DataFrame:
    """linear: noisy dot product with random weights; sinusoid and spiral: curves of one feature."""
    if kind == "linear":
        w = np.random.default_rng(seed).normal(size=p)
        x = spark.range(n).select(F.col("id").alias("sample_id"), F.array(*[F.randn(seed + k) for k in range(p)]).alias("features"))
        dot = F.aggregate(F.zip_with("features", F.lit(w.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return x.select("sample_id", (dot + F.randn(seed + p) * scale).alias("y"), "features")
    if kind not in ("sinusoid", "spiral"):
        raise ValueError(f"unknown kind {kind}")
    a = F.col("id") / n * 4 * np.pi
    y, x = (F.sin(a), F.col("id") / n) if kind == "sinusoid" else (F.col("id") / n * F.sin(a), F.col("id") / n * F.cos(a))
    return spark.range(n).select(F.col("id").alias("sample_id"), (y + F.randn(seed) * scale).alias("y"), F.array(x).alias("features"))


def erp_peaks(spark: SparkSession, n: int, times: int, centre: list[float], width: list[float], amplitude: list[float], weight: list[list[float]], shape: str = "gaussian", scale: float = 0.1, smooth: int = 5, seed: int = 42) -> DataFrame:
    """Peaks over time projected to channels, plus noise smoothed by a moving sum. One row per sample and time."""
    t = F.col("t").cast("double")
    forms = {
        "gaussian": lambda c, w: F.exp(-((t - c) ** 2) / (2 * w * w)),
        "cosine": lambda c, w: F.when(F.abs(t - c) <= w, (F.cos((t - c) * np.pi / w) + 1) / 2).otherwise(0.0),
        "triangle": lambda c, w: F.greatest(F.lit(0.0), 1 - F.abs(t - c) / w),
    }
    sources = [forms[shape](c, w) * a for c, w, a in zip(centre, width, amplitude)]
    noise = lambda k: sum((F.randn(seed + k * 101 + lag) for lag in range(smooth)), F.lit(0.0)) * (scale / np.sqrt(smooth))
    channels = [sum((s * w[k] for s, w in zip(sources, weight)), F.lit(0.0)) + noise(k) for k in range(len(weight[0]))]
    grid = spark.range(n).select(F.col("id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("t"))
    return grid.select("sample_id", "t", F.array(*channels).alias("features"))


def bandpass(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """Zero-phase band pass along the last axis by masking the spectrum."""
    freq = np.fft.rfftfreq(x.shape[-1], 1 / fs)
    return np.fft.irfft(np.fft.rfft(x) * ((freq >= low) & (freq <= high)), x.shape[-1])


def oscillation_arrays(n: int = 100, channels: int = 8, times: int = 256, fs: float = 256, bands: tuple[tuple[float, float], ...] = ((8, 12),), amplitude: np.ndarray | None = None, seed: int = 42, coupled: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(X n x channels x times, labels, mixing): narrow-band sources, stronger in one class each, over 1/f noise.

    ``coupled`` lets all sources share one phase course.
    """
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2 + 1
    k = len(bands)
    amplitude = np.array([[2.0, 1.0], [1.0, 2.0]])[:, np.arange(k) % 2] if amplitude is None else amplitude
    mixing = rng.normal(size=(channels, k))
    shared = rng.normal(size=(n, 1, times))
    raw = np.repeat(shared, k, 1) if coupled else rng.normal(size=(n, k, times))
    s = np.stack([bandpass(raw[:, i], fs, *b) for i, b in enumerate(bands)], 1)
    s /= s.std(axis=-1, keepdims=True)
    freq = np.maximum(np.fft.rfftfreq(times, 1 / fs), fs / times)
    noise = np.fft.irfft(np.fft.rfft(rng.normal(size=(n, channels, times))) / np.sqrt(freq), times)
    noise /= noise.std()
    return np.einsum("ck,nkt->nct", mixing, s * amplitude[y - 1][:, :, None]) + noise, y, mixing


def oscillations(spark: SparkSession, coupled: bool = False, **arrays) -> DataFrame:
    """One row per sample and time point, channels as features."""
    x, y, _ = oscillation_arrays(coupled=coupled, **arrays)
    data = [(i, int(y[i]), t, x[i, :, t].tolist()) for i in range(len(x)) for t in range(x.shape[2])]
    return spark.createDataFrame(data, "sample_id BIGINT, clabel INT, t INT, features ARRAY<DOUBLE>")
