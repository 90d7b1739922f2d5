"""One regression per segment and fold on lags, dates, statics and drivers, fitted in one pass for all folds.

* **Features.** Date, lag and rolling features; the drivers ``snap``, ``is_event``, ``price_norm`` (price over the mean price so
  far) and ``price_change_pct``; and for each static attribute the mean demand of its value up to the first cutoff, a number that
  a linear model can use. Nothing looks beyond a row's day or the first cutoff.
* **Fit.** A fold trains on the rows up to its cutoff. A row's band is the number of cutoffs before it, so the sums
  of products of a fold are the sums of the first bands: gathered once per (segment, band), added up per segment. Tasks send one
  small matrix per segment and band, so a segment that holds most rows costs no single task more.
* **Forecast.** The states of all folds (last 28 values, known future drivers) are rows of one table; the recursion over the
  horizon runs in batches of them. Future prices are the last known ones.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.expr import STATICS, ratio
from demandloom.models.panel_models import BASE_FEATURES, TAIL, YEAR_ORIGIN, Scorer, recurse_batches, training_frame
from demandloom.models.series import as_dates
from demandloom.operators.features import feat_event, feat_snap
from demandloom.operators.folds import fold_test
from demandloom.operators.reshape import latest
from demandloom.session import settle

DRIVERS = ("snap", "is_event", "price_norm", "price_change_pct")
MEANS = tuple(f"mean_{c}" for c in STATICS)
FEATURES = (*BASE_FEATURES, *DRIVERS, *MEANS)
RIDGE = 1.0


def static_means(panel: DataFrame, as_of: Column) -> DataFrame:
    """``unique_id`` and the mean y of each of its static values up to ``as_of``; values unknown then have the overall mean."""
    past = panel.where(F.col("ds") <= as_of).groupBy("unique_id", *STATICS).agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    past = settle(past)
    overall = F.lit(float(past.agg(F.sum("s") / F.sum("n")).first()[0] or 0.0))
    out = panel.select("unique_id", *STATICS).distinct()
    for c in STATICS:
        out = out.join(past.groupBy(c).agg((F.sum("s") / F.sum("n")).alias(f"_m_{c}")), c, "left")
    return out.select("unique_id", *[F.coalesce(F.col(f"_m_{c}").cast("double"), overall).alias(f"mean_{c}") for c in STATICS])


def _price_features(df: DataFrame) -> DataFrame:
    """Price over its mean so far (1 if unknown), and the change against the previous row (0 if unknown)."""
    by_day = W.partitionBy("unique_id").orderBy("ds")
    price, before = F.col("sell_price"), F.lag("sell_price").over(by_day)
    so_far = F.avg("sell_price").over(by_day.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumns(
        {"price_norm": F.coalesce(ratio(price, so_far), F.lit(1.0)), "price_change_pct": F.coalesce(ratio(price - before, before), F.lit(0.0))}
    )


def segment_frame(panel: DataFrame, calendar: DataFrame, states: Sequence[str], as_of: Column) -> DataFrame:
    """Training rows: keys, ``ds``, ``y`` and FEATURES. A calendar has one row per day (broadcast)."""
    rows = training_frame(panel.join(F.broadcast(calendar), "ds")).transform(feat_snap, states).transform(feat_event).transform(_price_features)
    return rows.join(static_means(panel, as_of), "unique_id")


def _design(pdf: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    x = pdf[list(features)].to_numpy(dtype=float)
    if "year" in features:
        x[:, list(features).index("year")] -= YEAR_ORIGIN
    return np.column_stack([np.ones(len(pdf)), np.nan_to_num(x)])


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds up the matrices ``m`` (bytes) by key."""
    keys = list(keys)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].iloc[:1].assign(m=[np.sum([np.frombuffer(v) for v in pdf["m"]], axis=0).tobytes()])

    return parts.groupBy(*keys).applyInPandas(add, parts.select(*keys, "m").schema)


def _band(cuts: Sequence[dt.date]) -> Column:
    return sum((F.when(F.col("ds") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def fit_folds(train: DataFrame, keys: Sequence[str], cuts: Sequence[dt.date], features: Sequence[str] = FEATURES, ridge: float = RIDGE) -> DataFrame:
    """Ridge regressions ``<keys>, cutoff, beta`` (intercept first) of every segment and fold with rows."""
    keys, p, cuts = list(keys), len(features) + 1, list(cuts)

    def products(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.column_stack([_design(pdf, features), pdf["y"].to_numpy(dtype=float)])
            for key, at in pdf.groupby([*keys, "band"], sort=False).indices.items():
                total[key] = total.get(key, 0.0) + z[at].T @ z[at]
        if total:
            yield pd.DataFrame(list(total), columns=[*keys, "band"]).assign(m=[v.tobytes() for v in total.values()])

    rows = train.where(F.col("ds") <= F.lit(max(cuts))).select(*keys, _band(cuts).alias("band"), F.col("y").cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    names = ", ".join(f"{k} string" for k in keys)
    sums = _summed(rows.mapInPandas(products, f"{names}, band int, m binary"), [*keys, "band"])
    bands = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("band", "m"))).alias("bands"))

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                whole, parts = np.zeros((p + 1, p + 1)), {b["band"]: np.frombuffer(b["m"]).reshape(p + 1, p + 1) for b in row.bands}
                for f, cut in enumerate(cuts):
                    whole = whole + parts.get(f, 0.0)
                    if whole[0, 0] > 0:
                        out.append((*row[: len(keys)], cut, np.linalg.solve(whole[:p, :p] + ridge * np.eye(p), whole[:p, p]).tolist()))
            yield pd.DataFrame(out, columns=[*keys, "cutoff", "beta"])

    return settle(bands.mapInPandas(solve, f"{names}, cutoff date, beta array<double>"))


def score_equations(train: DataFrame, models: DataFrame, keys: Sequence[str], cuts: Sequence[dt.date], features: Sequence[str] = FEATURES, ridge: float = RIDGE) -> DataFrame:
    """``<keys>, cutoff, feature, equation``: the condition of each coefficient, sum x (y - x'beta) - ridge beta, as a share of sum |x y|.

    A second pass over the training rows, from the coefficients alone.
    """
    keys, p, cuts = list(keys), len(features) + 1, list(cuts)
    betas = models.groupBy(*keys).agg(F.collect_list(F.struct("cutoff", "beta")).alias("models"))

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, ds = _design(pdf, features), pdf["y"].to_numpy(dtype=float), pd.to_datetime(pdf["ds"])
            for key, at in pdf.groupby(keys, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                for m in pdf["models"].iloc[at[0]]:
                    here = at[(ds.iloc[at] <= pd.Timestamp(m["cutoff"])).to_numpy()]
                    if len(here):
                        gap = y[here] - x[here] @ np.asarray(m["beta"])
                        part = np.concatenate([x[here].T @ gap, np.abs(x[here]).T @ np.abs(y[here])])
                        total[(*key, m["cutoff"])] = total.get((*key, m["cutoff"]), 0.0) + part
        if total:
            yield pd.DataFrame(list(total), columns=[*keys, "cutoff"]).assign(m=[v.tobytes() for v in total.values()])

    rows = train.select(*keys, "ds", F.col("y").cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features]).join(betas, keys)
    names = ", ".join(f"{k} string" for k in keys)
    sums = _summed(rows.mapInPandas(run, f"{names}, cutoff date, m binary"), [*keys, "cutoff"])

    def relative(batches):
        for pdf in batches:
            m, beta = (np.array([np.asarray(v) for v in c]) for c in ([np.frombuffer(v) for v in pdf["m"]], pdf["beta"]))
            m, beta = m.reshape(len(pdf), 2 * p), beta.reshape(len(pdf), p)
            share = (m[:, :p] - ridge * beta) / np.maximum(m[:, p:], 1.0)
            yield pdf[[*keys, "cutoff"]].assign(equations=list(share.tolist()))

    found = sums.join(models, [*keys, "cutoff"]).mapInPandas(relative, f"{names}, cutoff date, equations array<double>")
    label = F.element_at(F.lit(["intercept", *features]), F.col("_k") + 1).alias("feature")
    return found.select(*keys, "cutoff", F.posexplode("equations").alias("_k", "equation")).select(*keys, "cutoff", label, "equation")


def fold_states(panel: DataFrame, calendar: DataFrame, states: Sequence[str], cuts: Sequence[dt.date], h: int, as_of: Column, keys: Sequence[str]) -> DataFrame:
    """One row per series and cutoff: last values, statics, and the known future of each driver as an array."""
    folds = F.array(*[F.lit(c) for c in cuts])
    near = panel.where(F.col("ds") > F.date_sub(F.lit(min(cuts)), TAIL)).withColumn("cutoff", F.explode(folds))
    near = near.where((F.col("ds") <= F.col("cutoff")) & (F.col("ds") > F.date_sub("cutoff", TAIL)))
    values = F.transform(F.sort_array(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("v")))), lambda s: F.coalesce(s["v"], F.lit(0.0)))
    hist = near.groupBy("unique_id", "cutoff").agg(values.alias("hist"))
    hist = hist.withColumn("hist", F.concat(F.array_repeat(F.lit(0.0), F.lit(TAIL) - F.size("hist")), "hist"))
    price = F.col("sell_price")
    prices = panel.groupBy("unique_id", *STATICS).agg(
        *[F.max_by(price, F.when((F.col("ds") <= F.lit(c)) & price.isNotNull(), F.col("ds"))).alias(f"_p{k}") for k, c in enumerate(cuts)],
        *[F.avg(F.when(F.col("ds") <= F.lit(c), price)).alias(f"_a{k}") for k, c in enumerate(cuts)],
    )
    known = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.coalesce(ratio(F.col(f"_p{k}"), F.col(f"_a{k}")), F.lit(1.0)).alias("price")) for k, c in enumerate(cuts)])
    prices = prices.select("unique_id", *STATICS, F.inline(known))
    days = calendar.select("*", F.explode(folds).alias("cutoff")).where((F.col("ds") > F.col("cutoff")) & (F.col("ds") <= F.date_add("cutoff", h)))
    here = [r["state_id"] for r in panel.select("state_id").distinct().collect()]  # states: a few
    days = days.withColumn("state_id", F.explode(F.lit(here or [""]))).transform(feat_snap, states).transform(feat_event)
    steps = F.sort_array(F.collect_list(F.struct("ds", "snap", "is_event")))
    future = days.groupBy("state_id", "cutoff").agg(steps.alias("_f"))  # states x folds rows
    rows = hist.join(prices, ["unique_id", "cutoff"]).join(F.broadcast(future), ["state_id", "cutoff"]).join(static_means(panel, as_of), "unique_id")
    arrays = [F.col("_f.snap").cast("array<double>").alias("_x_snap"), F.col("_f.is_event").cast("array<double>").alias("_x_is_event")]
    flat = {"price_norm": F.col("price"), "price_change_pct": F.lit(0.0), **{m: F.col(m) for m in MEANS}}
    arrays += [F.array_repeat(v, h).alias(f"_x_{c}") for c, v in flat.items()]
    return rows.select("unique_id", "cutoff", "hist", *dict.fromkeys(keys), *arrays)


def segment_forecasts(panel: DataFrame, calendar: DataFrame, states: Sequence[str], h: int, points: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """``unique_id, cutoff, ds, Segmented`` for the days after every point."""
    cuts = as_dates(panel, points)
    as_of = F.lit(min(cuts))
    models = fit_folds(segment_frame(panel, calendar, states, as_of), keys, cuts)
    state = fold_states(panel, calendar, states, cuts, h, as_of, keys).join(models, [*keys, "cutoff"])
    return recurse_batches(state, h, Scorer(FEATURES), "Segmented", (*DRIVERS, *MEANS), with_cutoff=True)


def fc_segmented(panel: DataFrame, calendar: DataFrame, h: int, keys: Sequence[str] = ("store_id",), *, states: Sequence[str] = (), end: Column | None = None) -> DataFrame:
    """``unique_id, ds, Segmented`` for the days after the panel; ``calendar`` reaches as far."""
    point = latest(panel) if end is None else end
    return segment_forecasts(panel, calendar, states, h, [point], keys).drop("cutoff")


def cv_segmented(panel: DataFrame, calendar: DataFrame, h: int, points: Sequence[Column], keys: Sequence[str] = ("store_id",), *, states: Sequence[str] = ()) -> DataFrame:
    """Backtest ``unique_id, ds, cutoff, y, Segmented``: all folds in one pass."""
    truth = fold_test(panel, list(points), h).select("unique_id", "ds", "cutoff", F.col("y").cast("double").alias("y"))
    return truth.join(segment_forecasts(panel, calendar, states, h, points, keys), ["unique_id", "ds", "cutoff"])

