"""Batch inference of an external pretrained forecaster over context windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.features import feat_context_window
from demandloom.operators.folds import fold_test
from demandloom.operators.reshape import latest

# loads the model once per worker and returns predict(contexts (n x length), h) -> medians (n x h)
Loader = Callable[[], Callable[[np.ndarray, int], np.ndarray]]


def seasonal_naive_loader(season: int = 7) -> Loader:
    """Stand-in predictor: repeats the last season of the context."""

    def load() -> Callable[[np.ndarray, int], np.ndarray]:
        return lambda contexts, h: contexts[:, -season:][:, np.arange(h) % season]

    return load


def _infer(contexts: DataFrame, loader: Loader, h: int, name: str, batch_size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = loader()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                median = predict(np.array(part["context"].tolist(), dtype=float), h)
                yield part.drop(columns="context").assign(_f=[[float(v) for v in row] for row in median])

    keys = [f for f in contexts.schema.fields if f.name != "context"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", _f array<double>"
    rows = contexts.mapInPandas(run, schema)
    cols = [f.name for f in keys]
    stepped = rows.select(*cols, F.posexplode("_f").alias("_k", name))
    return stepped.withColumn("ds", F.date_add("cutoff", F.col("_k") + 1)).drop("_k")


def fc_pretrained(panel: DataFrame, loader: Loader, h: int, *, name: str = "Pretrained", context: int = 512, batch_size: int = 32) -> DataFrame:
    """``unique_id, ds, <name>`` for the days after the panel's last day."""
    windows = feat_context_window(panel, context).withColumn("cutoff", latest(panel))
    return _infer(windows, loader, h, name, batch_size).select("unique_id", "ds", name)


def cv_pretrained(
    panel: DataFrame, loader: Loader, h: int, points: Sequence[Column], *, name: str = "Pretrained", context: int = 512, batch_size: int = 32
) -> DataFrame:
    """Backtest. Each fold's context ends at its cutoff, so no test value is seen."""
    windows = None
    for point in points:
        part = feat_context_window(panel.where(F.col("ds") <= point), context).withColumn("cutoff", point)
        windows = part if windows is None else windows.unionByName(part)
    forecast = _infer(windows, loader, h, name, batch_size)
    truth = fold_test(panel, list(points), h).select("unique_id", "ds", "cutoff", F.col("y").cast("double").alias("y"))
    return truth.join(forecast, ["unique_id", "ds", "cutoff"])


