"""Entry points: cross-validated classification and regression over tensor frames.

One group of the plan is one (repeat, search position): its samples are packed, all its folds are fitted in one Arrow
call and only predictions leave it, so rows are not copied once per fold. Generalization over a dimension fits a table
of models, one group per (repeat, position), and scores it by a join, so no task holds all positions. Predictions that
several metrics need are written once. Metrics are relational.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import bayes, models
from ..operators import folds as cv
from ..sources.tensors import TensorFrame
from .stages import ARRAY_STAGES, register_array_stage  # noqa: F401
from .written import written


@dataclass(frozen=True)
class AnalysisSpec:
    """What to compute; validated when it is made."""

    model: str = "lda"
    metric: Sequence[str] = ("accuracy",)
    cv: str = "kfold"
    k: int = 5
    p: float = 0.1
    repeat: int = 5
    stratify: bool = True
    fold_column: str = "fold"
    hyperparameter: dict[str, Any] = field(default_factory=dict)
    preprocess: Sequence[tuple[str, dict[str, Any]]] = ()
    generalize: str | None = None
    random: bool = False
    group_size: int = 5
    append: bool = False
    within: Sequence[str] = ()

    def __post_init__(self):
        if self.model in models.SOLVERS:  # options of an external solver, carried out by a model here
            model, params = models.solver_model(self.model, self.hyperparameter)
            object.__setattr__(self, "model", model)
            object.__setattr__(self, "hyperparameter", params)
        if self.model not in models.MODELS:
            raise ValueError(f"unknown model {self.model}")
        if self.append and (self.model != "naive_bayes" or self.preprocess or self.generalize or set(self.metric) - {"accuracy", "acc", "confusion", "precision", "recall", "f1", "kappa"}):
            raise ValueError("append takes naive_bayes without stages, and metrics of class labels")
        if self.cv not in ("kfold", "leaveout", "leaveout_grouped", "holdout", "predefined", "none"):
            raise ValueError(f"unknown cross-validation {self.cv}")
        if bad := [n for n, _ in self.preprocess if n not in ARRAY_STAGES]:
            raise ValueError(f"unknown stages {bad}")
        if self.k < 2 or not 0 < self.p < 1:
            raise ValueError("k must be 2 or more and p between 0 and 1")

    @property
    def regression(self) -> bool:
        return self.model in models.REGRESSION

    @property
    def output(self) -> str:
        return "dval" if set(self.metric) & set(metrics.CONTINUOUS) else "clabel"

    def params(self) -> dict[str, Any]:
        return models.DEFAULTS.get(self.model, {}) | self.hyperparameter

    def folds(self, samples: DataFrame) -> DataFrame:
        repeats = 1 if self.cv in ("leaveout", "leaveout_grouped", "predefined", "none") else self.repeat
        if self.cv == "leaveout_grouped":
            return cv.leaveout_grouped(samples, self.group_size, self.random)
        strata = self.stratify and not self.regression
        if self.cv == "kfold":
            return cv.kfold(samples, self.k, repeats, strata, self.random, self.within)
        if self.cv == "holdout":
            return cv.holdout(samples, self.p, repeats, strata, self.random, self.within)
        return {"leaveout": cv.leaveout, "predefined": lambda s: cv.predefined(s, self.fold_column), "none": cv.none}[self.cv](samples)


@dataclass(frozen=True)
class Steps:
    """What a worker runs: functions and parameters looked up on the driver, so that registered ones reach it."""

    stages: Sequence[tuple[Callable, dict[str, Any]]]
    fit_model: Callable
    predict_model: Callable
    params: dict[str, Any]
    fit_folds: Callable | None = None

    @classmethod
    def of(cls, spec: AnalysisSpec) -> Steps:
        params = spec.params()
        whole = not spec.preprocess and not any(isinstance(v, (list, tuple, np.ndarray)) for v in params.values())  # nothing is fitted before the model
        return cls([(ARRAY_STAGES[n], p) for n, p in spec.preprocess], *models.MODELS[spec.model], params, models.FOLDS.get(spec.model) if whole else None)

    def fit(self, x: np.ndarray, y: np.ndarray) -> tuple[list, Any]:
        """(applications of the nested stages, model) fitted to training samples."""
        applied = []
        for stage, p in self.stages:
            x, y, apply = stage(x, y, p)
            applied.append(apply)
        return applied, self.fit_model(x, y, self.params)

    def predict(self, fitted: tuple[list, Any], x: np.ndarray, y: np.ndarray, sample: np.ndarray) -> pd.DataFrame:
        """sample_id, y, pred, dval, prob of test samples."""
        rows = np.arange(len(x))
        for apply in fitted[0]:
            x, y, rows = apply(x, y, rows)
        got = self.predict_model(fitted[1], x)
        nan = np.full(len(x), np.nan)
        return pd.DataFrame({"sample_id": sample[rows], "y": y, "pred": got["pred"], "dval": got.get("dval", nan), "prob": got.get("prob", nan)})


def _arrays(part: pd.DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = part.sort_values("sample_id")
    return np.stack(part["features"].to_numpy()).astype(float), part[label].to_numpy(), part["sample_id"].to_numpy()


def _fits(steps: Steps, all_train: bool, part: pd.DataFrame, label: str):
    """Yield (fold, test rows, fitted) of the folds that test samples of the group."""
    part = part.sort_values("sample_id")
    x, y, fold = np.stack(part["features"].to_numpy()).astype(float), part[label].to_numpy(), part["fold"].to_numpy()
    wanted = np.unique(fold[fold > 0]).tolist()
    if steps.fit_folds and wanted and not all_train:
        yield from ((f, fold == f, ([], model)) for f, model in steps.fit_folds(x, y, fold, steps.params, wanted))
        return
    for f in wanted:
        train = np.ones(len(fold), bool) if all_train else fold != f
        yield int(f), fold == f, steps.fit(x[train], y[train])


def _with(frame: pd.DataFrame, **values) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({k: [v] * len(frame) for k, v in values.items()}), frame], axis=1)


def predictions(t: TensorFrame, spec: AnalysisSpec, train_at: Sequence[int] | None = None, test_at: Sequence[int] | None = None) -> DataFrame:
    """(repeat, search..., [t_test], fold, sample_id, y, pred, dval, prob); the positions apply to ``generalize``."""
    label, gen, steps, all_train = t.label, spec.generalize, Steps.of(spec), spec.cv == "none"
    keep = list(dict.fromkeys(["sample_id", label, *spec.within, *([spec.fold_column] if spec.cv == "predefined" else [])]))
    samples = t.df.select(*keep).dropDuplicates(["sample_id"])
    folds = spec.folds(samples.withColumnRenamed(label, "clabel") if label != "clabel" and not spec.regression else samples)
    folds = written(folds) if gen else folds  # read twice: random folds must not be drawn anew
    data = t.df.select("sample_id", label, "features", *t.search).join(folds, "sample_id")
    group = ["repeat", *[s for s in t.search if s != gen]]
    kind = "DOUBLE" if spec.regression else "INT"
    tail = f"sample_id BIGINT, y {kind}, pred {kind}, dval DOUBLE, prob DOUBLE"
    if not gen:

        def run(key, part: pd.DataFrame) -> pd.DataFrame:
            x, y, sample = _arrays(part, label)
            out = [_with(steps.predict(fitted, x[test], y[test], sample[test]), **dict(zip(group, key)), fold=f) for f, test, fitted in _fits(steps, all_train, part, label)]
            return pd.concat(out, ignore_index=True)

        return data.groupBy(*group).applyInPandas(run, ", ".join([*(f"{g} INT" for g in group), "fold INT", tail]))

    def fit(key, part: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, f, cloudpickle.dumps(fitted)) for f, _, fitted in _fits(steps, all_train, part, label)]
        return pd.DataFrame(rows, columns=[*group, gen, "fold", "model"])

    at = lambda df, wanted: df if wanted is None else df.where(F.col(gen).isin(list(wanted)))
    fitted = at(data, train_at).groupBy(*group, gen).applyInPandas(fit, ", ".join([*(f"{g} INT" for g in [*group, gen]), "fold INT", "model BINARY"]))
    # models meet the test rows of their fold in blocks of positions: a model is copied once per block
    blocks = 8
    tests = at(data, test_at).where("fold > 0").withColumn("block", F.pmod(F.hash(gen), F.lit(blocks)))
    keys = [*group, "fold", "block"]

    def score(key, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = []
        parts = [(v, _arrays(p, label)) for v, p in rows.groupby(gen)]
        for v, packed in zip(table[gen], table["model"]):
            model = cloudpickle.loads(packed)
            out += [_with(steps.predict(model, *arrays), **dict(zip(group, key)), **{gen: v, "t_test": u, "fold": key[-2]}) for u, arrays in parts]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[*group, gen, "t_test", "fold", "sample_id", "y", "pred", "dval", "prob"])

    copied = fitted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = ", ".join([*(f"{g} INT" for g in group), f"{gen} INT", "t_test INT", "fold INT", tail])
    return tests.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInPandas(score, schema)


def appended(t: TensorFrame, spec: AnalysisSpec) -> DataFrame:
    """The same predictions for all search positions at once: relational naive Bayes, one table of models."""
    keep = list(dict.fromkeys(["sample_id", t.label, *spec.within, *([spec.fold_column] if spec.cv == "predefined" else [])]))
    folds = spec.folds(t.df.select(*keep).dropDuplicates(["sample_id"]).withColumnRenamed(t.label, "clabel"))
    data = t.df.select("sample_id", F.col(t.label).alias("clabel"), "features", *t.search).join(folds, "sample_id")
    wide = TensorFrame(data, ("repeat", *t.search))
    fitted = bayes.fit_all(wide) if spec.cv == "none" else bayes.fit_folds(wide)
    on = [*wide.search, *([] if spec.cv == "none" else ["fold"])]
    got = bayes.score(data.where("fold > 0"), fitted, on, spec.params()["prior"])
    nan = F.lit(float("nan"))
    return got.select("repeat", *t.search, "fold", "sample_id", F.col("clabel").alias("y"), F.col("pred").cast("int").alias("pred"), nan.alias("dval"), nan.alias("prob"))


def _evaluate(pred: DataFrame, spec: AnalysisSpec, keys: list[str], classes: int, average: bool = True) -> DataFrame:
    out = []
    pred = written(pred) if len(spec.metric) > 1 else pred  # fitted once for all metrics
    for name in spec.metric:
        per = metrics.evaluate(pred, name, ["repeat", "fold", *keys], spec.output if name in ("accuracy", "acc") else "clabel", classes)
        extra = [c for c in ("class_i", "class_j") if c in per.columns]
        got = metrics.fold_average(per, [*keys, *extra]) if average else per.select(*keys, *extra, "perf").withColumn("perf_std", metrics.nan())
        for c in ("class_i", "class_j"):
            if c not in got.columns:
                got = got.withColumn(c, F.lit(None).cast("int"))
        out.append(got.select(F.lit(name).alias("metric"), *keys, "class_i", "class_j", "perf", "perf_std"))
    return reduce(DataFrame.unionByName, out)


def classify(t: TensorFrame, spec: AnalysisSpec, classes: int | None = None, train_at: Sequence[int] | None = None, test_at: Sequence[int] | None = None) -> DataFrame:
    """Metrics by search position: (metric, search..., [t_test], class_i, class_j, perf, perf_std)."""
    if classes is None:
        classes = int(t.df.agg(F.max(t.label)).first()[0] or 0)
    if classes > 2 and (spec.model in models.BINARY or set(spec.metric) & set(metrics.BINARY_ONLY)):
        raise ValueError("this model or metric takes two classes")
    keys = [*t.search, *(["t_test"] if spec.generalize else [])]
    pred = appended(t, spec) if spec.append else predictions(t, spec, train_at, test_at)
    return _evaluate(pred, spec, keys, classes, spec.cv != "none")


def regress(t: TensorFrame, spec: AnalysisSpec) -> DataFrame:
    """The same for responses in ``t.label``; folds are never stratified."""
    keys = [*t.search, *(["t_test"] if spec.generalize else [])]
    return _evaluate(predictions(t, spec), spec, keys, 0, spec.cv != "none")


def classify_across_time(t: TensorFrame, spec: AnalysisSpec, time: str = "t", times: Sequence[int] | None = None) -> DataFrame:
    return classify(t.where(F.col(time).isin(list(times))) if times is not None else t, spec)


def classify_time_by_time(t: TensorFrame, spec: AnalysisSpec, time: str = "t", train_times: Sequence[int] | None = None, test_times: Sequence[int] | None = None) -> DataFrame:
    """Train at each time, test at every time; the two selections are independent and made before anything is fitted."""
    return classify(t, replace(spec, generalize=time), None, train_times, test_times)


def transfer(train: TensorFrame, test: TensorFrame, spec: AnalysisSpec) -> DataFrame:
    """Fit on one dataset, predict another with the same search dimensions; no averaging."""
    keys, steps = list(train.search), Steps.of(spec)
    side = lambda t, tested: t.df.select("sample_id", F.col(t.label).alias("y"), "features", *keys, F.lit(tested).alias("is_test"))
    both = side(train, False).unionByName(side(test, True))
    kind = "DOUBLE" if spec.regression else "INT"
    schema = ", ".join([*(f"{k} INT" for k in keys), "repeat INT", "fold INT", "sample_id BIGINT", f"y {kind}", f"pred {kind}", "dval DOUBLE", "prob DOUBLE"])

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        tested = part["is_test"].to_numpy(bool)
        if tested.all() or not tested.any():
            return pd.DataFrame(columns=[*keys, "repeat", "fold", "sample_id", "y", "pred", "dval", "prob"])
        x, y, _ = _arrays(part[~tested], "y")
        return _with(steps.predict(steps.fit(x, y), *_arrays(part[tested], "y")), **dict(zip(keys, key)), repeat=1, fold=1)

    pred = both.withColumn("_one", F.lit(1)).groupBy(*(keys or ["_one"])).applyInPandas(run, schema)
    classes = 0 if spec.regression else int(both.agg(F.max("y")).first()[0] or 0)
    return _evaluate(pred, spec, keys, classes, average=False)


def fit_models(t: TensorFrame, spec: AnalysisSpec) -> DataFrame:
    """(search..., model BINARY): fitted models kept as a table, for ``streaming.score`` or later transfer."""
    import pickle

    keys, (fit, _), params, label = list(t.search) or ["_one"], models.MODELS[spec.model], spec.params(), t.label

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        x, y, _ = _arrays(part, label)
        model = fit(x, y, params)
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "model": [pickle.dumps(model)]})

    return t.df.withColumn("_one", F.lit(1)).groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} INT" for k in keys), "model BINARY"]))
