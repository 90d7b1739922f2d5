"""Running per-series models over a panel, for the future or for backtest folds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.reshape import latest
from demandloom.session import settle

# A series model maps (values in day order, horizon) to (forecast, fitted values).
SeriesModel = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]
# A batch model does so for many series at once.
BatchModel = Callable[[list[np.ndarray], int], list[tuple[np.ndarray, np.ndarray]]]
BATCH = 128  # series of one call of a batch model


def one_by_one(model: SeriesModel) -> BatchModel:
    return lambda many, h: [model(y, h) for y in many]


def as_dates(panel: DataFrame, points: Sequence[Column]) -> list[dt.date]:
    """The cutoff expressions as Python dates (a few constants)."""
    return list(panel.sparkSession.range(1).select(*[p.alias(f"c{i}") for i, p in enumerate(points)]).first())


def series_cv(panel: DataFrame, models: Mapping[str, SeriesModel], h: int, points: Sequence[Column]) -> DataFrame:
    """Backtest: ``unique_id, ds, cutoff, y, <model>...`` for the test rows of every fold.

    The panel is shuffled once by series; a group is one series, at most one row per day, and
    serves all folds. The truth comes from the same group, so there is no join.
    """
    cuts = [pd.Timestamp(c) for c in as_dates(panel, points)]
    fns = dict(models)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        days = pd.to_datetime(pdf["ds"])
        values = pdf["y"].to_numpy(dtype=float)
        parts = []
        for cut in cuts:
            history = values[(days <= cut).to_numpy()]
            test = ((days > cut) & (days <= cut + pd.Timedelta(days=h))).to_numpy()
            if not len(history) or not test.any():
                continue
            out = pd.DataFrame({"unique_id": pdf["unique_id"].iloc[0], "ds": pdf["ds"][test], "cutoff": cut.date(), "y": values[test]})
            step = (days[test] - cut).dt.days.to_numpy()
            for name, fn in fns.items():
                out[name] = fn(history, h)[0][step - 1]
            parts.append(out)
        return pd.concat(parts) if parts else pd.DataFrame(columns=["unique_id", "ds", "cutoff", "y", *fns])

    schema = "unique_id string, ds date, cutoff date, y double, " + ", ".join(f"`{m}` double" for m in fns)
    rows = panel.select("unique_id", "ds", F.col("y").cast("double").alias("y"))
    return rows.groupBy("unique_id").applyInPandas(run, schema)


def series_forecast(panel: DataFrame, models: Mapping[str, SeriesModel], h: int, end: Column | None = None) -> DataFrame:
    """``unique_id, ds, <model>...`` for the ``h`` days after the panel's last day."""
    last = pd.Timestamp(as_dates(panel, [latest(panel) if end is None else end])[0])
    future = [d.date() for d in pd.date_range(last + pd.Timedelta(days=1), periods=h)]
    fns = dict(models)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("ds")["y"].to_numpy(dtype=float)
        return pd.DataFrame({"unique_id": pdf["unique_id"].iloc[0], "ds": future, **{m: fn(values, h)[0] for m, fn in fns.items()}})

    schema = "unique_id string, ds date, " + ", ".join(f"`{m}` double" for m in fns)
    rows = panel.select("unique_id", "ds", F.col("y").cast("double").alias("y"))
    return rows.groupBy("unique_id").applyInPandas(run, schema)


def series_base(panel: DataFrame, model: SeriesModel, h: int, fit_days: int | None = None) -> DataFrame:
    """Per series the forecast and the fitted values and actuals as arrays of one length.

    The length is the panel's span in days, or ``fit_days``; days before a series began are NaN.

    ``unique_id, y_hat array(h), fitted array, actual array``: what reconciliation needs.
    Missing fitted values (the warm-up of a short series) are taken as the actual.
    """
    if fit_days is None:
        fit_days = panel.agg(F.datediff(F.max("ds"), F.min("ds"))).first()[0]
        fit_days = 0 if fit_days is None else fit_days + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("ds")["y"].to_numpy(dtype=float)
        ahead, inside = model(values, h)
        inside = np.where(np.isfinite(inside), inside, values)
        pad = max(fit_days - len(values), 0)
        tail = lambda a: [float("nan")] * pad + [float(v) for v in a[-fit_days:]]
        return pd.DataFrame(
            {"unique_id": [pdf["unique_id"].iloc[0]], "y_hat": [[float(v) for v in ahead]], "fitted": [tail(inside)], "actual": [tail(values)]}
        )

    schema = "unique_id string, y_hat array<double>, fitted array<double>, actual array<double>"
    rows = panel.select("unique_id", "ds", F.col("y").cast("double").alias("y"))
    return rows.groupBy("unique_id").applyInPandas(run, schema)


def apply_series_model(panel: DataFrame, model: SeriesModel, name: str, h: int, points: Sequence[Column] | None = None) -> DataFrame:
    """The extension point: any per-series function over the panel or over its folds."""
    if points is None:
        return series_forecast(panel, {name: model}, h)
    return series_cv(panel, {name: model}, h, points)


def fold_base(sparse: DataFrame, model: BatchModel, h: int, cuts: Sequence[dt.date]) -> DataFrame:
    """Base forecasts of every (fold, series): ``fold, node_id, y_hat array(h), fitted array, actual array``.

    ``sparse`` has ``node_id, ds, y`` with the non-zero days only; a series becomes one row (at most one value per day) and
    is filled with zeros where it is fitted, from its first day to the fold's cutoff. ``fold`` is the cutoff as text. Arrays of
    a fold have one length, the days from the first of any series; days before a series began are NaN. Missing fitted values
    are taken as the actual. A series without a day up to the cutoff has no row in the fold.
    """
    if not cuts:
        raise ValueError("no cutoffs")
    # few bytes, much work: a number of partitions that adaptive execution leaves alone
    parts = int(sparse.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    day = F.datediff("ds", F.lit(dt.date(1970, 1, 1))).alias("t")
    series = settle(sparse.repartition(parts, "node_id").groupBy("node_id").agg(F.collect_list(day).alias("t"), F.collect_list(F.col("y").cast("double")).alias("y")))
    first = series.agg(F.min(F.array_min("t"))).first()[0]
    origin = min(cuts) if first is None else dt.date(1970, 1, 1) + dt.timedelta(days=first)
    zero = (origin - dt.date(1970, 1, 1)).days
    spans = [((c - origin).days + 1, c.isoformat()) for c in cuts]

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                keys, starts, values = [], [], []
                for node, t, y in zip(part["node_id"], part["t"], part["y"]):
                    t, y = np.asarray(t, dtype=int) - zero, np.asarray(y, dtype=float)
                    start = int(t.min())
                    for span, fold in spans:
                        if span > start:
                            here = t < span
                            full = np.zeros(span - start)
                            np.add.at(full, t[here] - start, y[here])
                            keys.append((fold, node))
                            starts.append(start)
                            values.append(full)
                rows = []
                for (fold, node), start, y, (ahead, inside) in zip(keys, starts, values, model(values, h)):
                    inside = np.where(np.isfinite(inside), inside, y)
                    before = np.full(start, np.nan)
                    rows.append((fold, node, ahead, np.r_[before, inside], np.r_[before, y]))
                yield pd.DataFrame(rows, columns=["fold", "node_id", "y_hat", "fitted", "actual"])

    return series.mapInPandas(run, "fold string, node_id string, y_hat array<double>, fitted array<double>, actual array<double>")
