"""Scoring a stream of samples with a fixed linear or kernel model (an extension; the models are fitted in batch)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators import models


def score_stream(rows: DataFrame, model: dict, name: str) -> DataFrame:
    """``sample_id, features`` (batch or streaming) -> ``sample_id, pred, dval``."""
    bc = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                got = models.MODELS[name][1](bc.value, np.stack(part["features"].to_numpy()).astype(float))
                yield pd.DataFrame({"sample_id": part["sample_id"], "pred": got["pred"].astype(float), "dval": got.get("dval", np.full(len(part), np.nan))})

    return rows.select("sample_id", "features").mapInPandas(run, "sample_id BIGINT, pred DOUBLE, dval DOUBLE")
