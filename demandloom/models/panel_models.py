"""Models fitted on many series at once, with recursive multi-step forecasts.

A series' forecast state is one row: its last 28 values and the known future drivers as arrays.
Each step computes the features from that row and appends the prediction, so the recursion
needs no window, join or shuffle. Linear scores run all steps inside one Arrow batch function;
tree models are applied by Spark ML step by step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.expr import week_of_year
from demandloom.operators.features import feat_date, feat_difference, feat_lags, feat_rolling_lagged, undo_difference
from demandloom.operators.folds import fold_test
from demandloom.operators.reshape import encode_categoricals, latest
from demandloom.session import settle

LAGS = (7, 14, 28)
WINDOWS = (7, 28)
TAIL = 28
YEAR_ORIGIN = 2000  # years enter linear models as a small number
DATE_FEATURES = ("dayofweek", "day", "week", "month", "year")
LAG_FEATURES = (*[f"lag{k}" for k in LAGS], *[f"rolling_mean_lag1_window_size{w}" for w in WINDOWS])

Predict = Callable[[DataFrame], DataFrame]


def training_frame(panel: DataFrame, target: str = "y") -> DataFrame:
    """Date, lag and rolling features; rows without a full lag window are left out."""
    rows = panel.transform(feat_date).transform(feat_lags, LAGS, target).transform(feat_rolling_lagged, WINDOWS, target)
    return rows.dropna(subset=[*LAG_FEATURES, target])


def forecast_state(panel: DataFrame, target: str = "y", keep: Sequence[str] = ()) -> DataFrame:
    """One row per series: the last 28 values in day order as ``hist``, zero-padded in front."""
    end = latest(panel)
    recent = panel.where(F.col("ds") > F.date_sub(end, TAIL))
    values = F.sort_array(F.collect_list(F.struct("ds", F.col(target).cast("double").alias("v"))))
    tail = F.transform(values, lambda s: F.coalesce(s["v"], F.lit(0.0)))
    rows = recent.groupBy("unique_id").agg(tail.alias("hist"), *[F.max(c).alias(c) for c in keep])
    pad = F.array_repeat(F.lit(0.0), F.lit(TAIL) - F.size("hist"))
    return rows.withColumns({"hist": F.concat(pad, "hist"), "cutoff": end})


def step_features(state: DataFrame, step: int, exog: Sequence[str]) -> DataFrame:
    ds = F.date_add("cutoff", step)
    mean = lambda w: F.aggregate(F.slice("hist", -w, w), F.lit(0.0), lambda a, v: a + v) / w
    cols: dict[str, Column] = {
        "dayofweek": F.weekday(ds),
        "day": F.dayofmonth(ds),
        "week": week_of_year(ds),
        "month": F.month(ds),
        "year": F.year(ds),
        **{f"lag{k}": F.element_at("hist", -k) for k in LAGS},
        **{f"rolling_mean_lag1_window_size{w}": mean(w) for w in WINDOWS},
        **{c: F.element_at(f"_x_{c}", step) for c in exog},
    }
    return state.withColumns(cols)


def recurse(state: DataFrame, h: int, predict: Predict, name: str, exog: Sequence[str] = (), floor: float | None = 0.0) -> DataFrame:
    """Forecast ``h`` steps with a Spark ML model that adds a ``prediction`` column.

    The state (one row per series) is checkpointed after every step; chained unbroken, the
    plans of later steps would contain all earlier ones.
    """
    base = state.columns
    state = state.withColumn("_out", F.array().cast("array<double>"))
    for step in range(1, h + 1):
        scored = predict(step_features(state, step, exog))
        value = F.coalesce(F.col("prediction"), F.lit(0.0)).cast("double")
        value = F.greatest(value, F.lit(floor)) if floor is not None else value
        state = scored.withColumn("_v", value).select(
            *[c for c in base if c != "hist"],
            F.concat(F.slice("hist", 2, TAIL - 1), F.array("_v")).alias("hist"),
            F.concat("_out", F.array("_v")).alias("_out"),
        )
        if step < h:
            state = settle(state)
    rows = state.select("unique_id", "cutoff", F.posexplode("_out").alias("_k", name))
    return rows.select("unique_id", F.date_add("cutoff", F.col("_k") + 1).alias("ds"), name)


@dataclass(frozen=True)
class Scorer:
    """A linear score over named features: identity or log link, optionally on log1p of the lags.

    Without ``coefficients`` every state row brings its own in ``beta`` (intercept first).
    """

    features: tuple[str, ...]
    coefficients: tuple[float, ...] | None = None
    intercept: float = 0.0
    log_link: bool = False

    def score(self, values: dict[str, np.ndarray], beta: np.ndarray | None) -> np.ndarray:
        lagged = lambda f, v: np.log1p(np.maximum(v, 0.0)) if self.log_link and f in LAG_FEATURES else v
        x = np.column_stack([lagged(f, values[f]) for f in self.features])
        if beta is not None:
            return beta[:, 0] + np.sum(beta[:, 1:] * x, axis=1)
        total = self.intercept + x @ np.array(self.coefficients)
        return np.exp(np.minimum(total, 30.0)) if self.log_link else total


def recurse_batches(state: DataFrame, h: int, scorer: Scorer, name: str, exog: Sequence[str] = (), floor: float | None = 0.0, with_cutoff: bool = False) -> DataFrame:
    """Forecast ``h`` steps with a linear score, vectorised over the series of a batch."""
    own_beta = scorer.coefficients is None
    drivers = [f"_x_{c}" for c in exog]

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            hist = np.array(pdf["hist"].tolist(), dtype=float).reshape(n, TAIL)
            beta = np.array(pdf["beta"].tolist(), dtype=float) if own_beta and n else None
            known = {c: np.nan_to_num(np.array(pdf[f"_x_{c}"].tolist(), dtype=float).reshape(n, h)) for c in exog}
            cut = pd.to_datetime(pdf["cutoff"])
            out = np.empty((n, h))
            for k in range(h if n else 0):
                ds = (cut + pd.Timedelta(days=k + 1)).dt
                dow = ds.dayofweek.to_numpy()
                values = {
                    "dayofweek": dow,
                    "day": ds.day.to_numpy(),
                    "week": (ds.dayofyear.to_numpy() - dow + 10) // 7,
                    "month": ds.month.to_numpy(),
                    "year": ds.year.to_numpy() - YEAR_ORIGIN,
                    **{f"lag{j}": hist[:, -j] for j in LAGS},
                    **{f"rolling_mean_lag1_window_size{w}": hist[:, -w:].mean(axis=1) for w in WINDOWS},
                    **{c: v[:, k] for c, v in known.items()},
                }
                pred = scorer.score(values, beta)
                out[:, k] = pred if floor is None else np.maximum(pred, floor)
                hist = np.column_stack([hist[:, 1:], out[:, k]])
            yield pdf[["unique_id", "cutoff"]].assign(_out=[[float(v) for v in row] for row in out])

    cols = ["unique_id", "cutoff", "hist", *(["beta"] if own_beta else []), *drivers]
    rows = state.select(*cols).mapInPandas(run, "unique_id string, cutoff date, _out array<double>")
    stepped = rows.select("unique_id", "cutoff", F.posexplode("_out").alias("_k", name))
    return stepped.select("unique_id", *(["cutoff"] if with_cutoff else []), F.date_add("cutoff", F.col("_k") + 1).alias("ds"), name)


def attach_future(state: DataFrame, future: DataFrame, exog: Sequence[str]) -> DataFrame:
    """Known future drivers (``unique_id, ds, <exog>``) as one array per driver and series."""
    steps = F.sort_array(F.collect_list(F.struct("ds", *exog)))
    arrays = future.groupBy("unique_id").agg(steps.alias("_f"))
    cols = [F.transform(F.col("_f"), lambda s, c=c: s[c].cast("double")).alias(f"_x_{c}") for c in exog]
    return state.join(arrays.select("unique_id", *cols), "unique_id", "left")


def future_exog(panel: DataFrame, calendar: DataFrame, h: int, *, with_calendar: bool = True) -> DataFrame:
    """Future rows per series: statics, the last known price and the calendar of the day."""
    end = latest(panel)
    statics = [c for c in ("item_id", "dept_id", "cat_id", "store_id", "state_id") if c in panel.columns]
    known = F.max_by(F.col("sell_price"), F.when(F.col("sell_price").isNotNull(), F.col("ds")))
    last = panel.groupBy("unique_id", *statics).agg(known.alias("sell_price"))
    days = F.sequence(F.date_add(end, 1), F.date_add(end, h))
    rows = last.withColumn("ds", F.explode(days))
    return rows.join(F.broadcast(calendar), "ds", "left") if with_calendar else rows


# --- fitted heads ----------------------------------------------------------------------------


def _assembled(train: DataFrame, features: Sequence[str], log_lags: bool = False) -> DataFrame:
    rows = train.na.fill(0.0, list(features)).withColumn("year", F.col("year") - YEAR_ORIGIN)
    if log_lags:
        rows = rows.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in LAG_FEATURES})
    return VectorAssembler(inputCols=list(features), outputCol="_v").transform(rows)


def fit_linear(train: DataFrame, features: Sequence[str], target: str = "y") -> Scorer:
    """Least squares on the named features; nulls count as 0."""
    fit = LinearRegression(featuresCol="_v", labelCol=target, solver="normal", regParam=1e-8).fit(_assembled(train, features))
    return Scorer(tuple(features), tuple(float(c) for c in fit.coefficients), float(fit.intercept))


def fit_tweedie(train: DataFrame, features: Sequence[str], power: float = 1.1) -> Scorer:
    """Tweedie regression with log link; lags enter as log1p, close to linear under that link."""
    glm = GeneralizedLinearRegression(
        family="tweedie", variancePower=power, linkPower=0.0, featuresCol="_v", labelCol="y", maxIter=25, regParam=1e-6
    )
    # every step of the fit reads the rows again
    fit = glm.fit(settle(_assembled(train, features, log_lags=True).select("_v", "y")))
    return Scorer(tuple(features), tuple(float(c) for c in fit.coefficients), float(fit.intercept), log_link=True)


def fit_trees(train: DataFrame, features: Sequence[str], *, iterations: int = 10, depth: int = 4, seed: int = 42) -> Predict:
    """Boosted trees with squared loss."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="keep"),
        GBTRegressor(featuresCol="_v", labelCol="y", maxIter=iterations, maxDepth=depth, maxBins=64, stepSize=0.2, subsamplingRate=0.8, seed=seed),
    ]
    fit = Pipeline(stages=stages).fit(train.na.fill(0.0, list(features)))
    return fit.transform


BASE_FEATURES = (*DATE_FEATURES, *LAG_FEATURES)


def fc_global_tree(panel: DataFrame, h: int, statics: Sequence[str] = ("item_id", "store_id"), **options: int) -> DataFrame:
    """Global boosted trees on date, lag, rolling and encoded static features."""
    encoded = encode_categoricals(panel, statics)
    codes = [f"{c}_idx" for c in statics if c in panel.columns]
    predict = fit_trees(training_frame(encoded), [*BASE_FEATURES, *codes], **options)
    return recurse(forecast_state(encoded, keep=codes), h, predict, "Trees")


def fc_global_tweedie(panel: DataFrame, h: int, power: float = 1.1, future: DataFrame | None = None, exog: Sequence[str] = ()) -> DataFrame:
    """Global Tweedie regression; ``exog`` columns need their future values in ``future``."""
    state = forecast_state(panel)
    if exog:
        state = attach_future(state, future, exog)
    scorer = fit_tweedie(training_frame(panel), [*BASE_FEATURES, *exog], power)
    return recurse_batches(state, h, scorer, "Tweedie", exog)


def fc_global_linear(panel: DataFrame, h: int) -> DataFrame:
    """Linear model on the differenced target, undone by a running sum from the last level."""
    diffs = feat_difference(panel).where(F.col("y_diff").isNotNull())
    scorer = fit_linear(training_frame(diffs, "y_diff"), BASE_FEATURES, "y_diff")
    steps = recurse_batches(forecast_state(diffs, "y_diff"), h, scorer, "Linear", floor=None)
    last = panel.groupBy("unique_id").agg(F.max_by("y", "ds").cast("double").alias("level"))
    return undo_difference(steps, last, "Linear").select("unique_id", "ds", "Linear")


def cv_global(panel: DataFrame, forecaster: Callable[[DataFrame, int], DataFrame], h: int, points: Sequence[Column]) -> DataFrame:
    """Backtest of a whole-panel forecaster: one fit per fold on the rows up to its cutoff."""
    out = None
    for point in points:
        forecast = forecaster(panel.where(F.col("ds") <= point), h)
        truth = fold_test(panel, [point], h).select("unique_id", "ds", "cutoff", F.col("y").cast("double").alias("y"))
        part = truth.join(forecast, ["unique_id", "ds"])
        out = part if out is None else out.unionByName(part)
    return out


# --- one model per segment -------------------------------------------------------------------


# The three canonical segmentations.
SEGMENT_KEYS = {"store": ("store_id",), "store_cat": ("store_id", "cat_id"), "store_dept": ("store_id", "dept_id")}


@dataclass
class SegmentModel:
    """Coefficients per segment: ``<keys>, beta`` with the intercept first."""

    keys: tuple[str, ...]
    features: tuple[str, ...]
    table: DataFrame


def segment_profile(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series and rows per segment, counted from a per-series aggregate."""
    per = panel.groupBy(*keys, "unique_id").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_series"), F.sum("n").alias("n_rows"))


def fit_segments(train: DataFrame, keys: Sequence[str], features: Sequence[str] = BASE_FEATURES, ridge: float = 1.0) -> SegmentModel:
    """Ridge regression in every segment from its sums of products.

    The sums are ordinary aggregates, combined map-side: a segment that holds most rows costs
    no single task more, and only a small matrix per segment is solved in Python.
    """
    keys, p = list(keys), len(features) + 1
    shift = lambda f: F.col(f) - YEAR_ORIGIN if f == "year" else F.col(f)
    x: list[Column] = [F.lit(1.0), *[F.coalesce(shift(f).cast("double"), F.lit(0.0)) for f in features]]
    products = [F.sum(x[i] * x[j]).alias(f"a_{i}_{j}") for i in range(p) for j in range(i, p)]
    targets = [F.sum(x[i] * F.col("y")).alias(f"b_{i}") for i in range(p)]
    sums = train.groupBy(*keys).agg(*products, *targets)

    def solve(batches):
        for pdf in batches:
            betas = []
            for row in pdf.to_dict("records"):
                a = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        a[i, j] = a[j, i] = row[f"a_{i}_{j}"]
                b = np.array([row[f"b_{i}"] for i in range(p)])
                betas.append([float(v) for v in np.linalg.solve(a + ridge * np.eye(p), b)])
            yield pdf[keys].assign(beta=betas) if betas else pd.DataFrame(columns=[*keys, "beta"])

    schema = ", ".join(f"{k} string" for k in keys) + ", beta array<double>"
    return SegmentModel(tuple(keys), tuple(features), settle(sums.mapInPandas(solve, schema)))


def fc_segmented(panel: DataFrame, h: int, keys: Sequence[str] = ("store_id",), features: Sequence[str] = BASE_FEATURES) -> DataFrame:
    """One model per segment, all fitted in one pass, forecasts stacked."""
    model = fit_segments(training_frame(panel), keys, features)
    state = forecast_state(panel, keep=keys).join(model.table, list(keys))

    return recurse_batches(state, h, Scorer(tuple(features)), "Segmented")


def cv_segmented(panel: DataFrame, h: int, points: Sequence[Column], keys: Sequence[str] = ("store_id",)) -> DataFrame:
    return cv_global(panel, lambda p, n: fc_segmented(p, n, keys), h, points)


# --- count regression with pooling -----------------------------------------------------------

_COUNT_TERMS = 9  # six weekday effects after Monday, intercept, price, snap


def _count_terms() -> list[Column]:
    days = [(F.col("dayofweek") == d).cast("double") for d in range(1, 7)]
    return [F.lit(1.0), *days, F.coalesce(F.col("price_norm"), F.lit(1.0)) - 1.0, F.col("snap").cast("double")]


def fit_count_glm(cells: DataFrame, key: str, *, max_iter: int = 100, tol: float = 1e-8, ridge: float = 1.0) -> DataFrame:
    """Poisson regression with log link per key: ``<key>, beta``.

    ``cells`` has one row per (key, covariates) with ``n`` days and total ``y``, which is all a
    Poisson fit needs. Each Newton step is one grouped aggregate and a small solve per key. Steps are
    at most 2 per coefficient; they go on until the largest is below ``tol``, else an error is raised.
    """
    x, p = _count_terms(), _COUNT_TERMS
    beta = cells.groupBy(key).agg(F.log(F.greatest(F.sum("y") / F.sum("n"), F.lit(1e-3))).alias("_l"))
    start = F.concat(F.array("_l"), F.array_repeat(F.lit(0.0), p - 1))
    beta = beta.select(key, start.alias("beta"), F.lit(0.0).alias("_step"))

    def solve(batches):
        for pdf in batches:
            out, moved = [], []
            for row in pdf.to_dict("records"):
                a = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        a[i, j] = a[j, i] = row[f"a_{i}_{j}"]
                old = np.array(row["beta"])
                shrink = ridge * np.r_[0.0, np.ones(p - 1)]
                step = np.linalg.solve(a + np.diag(shrink) + 1e-9 * np.eye(p), np.array([row[f"g_{i}"] for i in range(p)]) - shrink * old)
                out.append([float(v) for v in old + np.clip(step, -2.0, 2.0)])
                moved.append(float(np.abs(step).max()))
            yield pdf[[key]].assign(beta=out, _step=moved) if out else pd.DataFrame(columns=[key, "beta", "_step"])

    for _ in range(max_iter):
        rows = cells.join(beta.select(key, "beta"), key)
        eta = sum((F.element_at("beta", i + 1) * x[i] for i in range(p)), F.lit(0.0))
        mu = F.col("n") * F.exp(F.least(eta, F.lit(30.0)))
        rows = rows.withColumn("_mu", mu)
        curve = [F.sum(F.col("_mu") * x[i] * x[j]).alias(f"a_{i}_{j}") for i in range(p) for j in range(i, p)]
        slope = [F.sum((F.col("y") - F.col("_mu")) * x[i]).alias(f"g_{i}") for i in range(p)]
        sums = rows.groupBy(key).agg(F.first("beta").alias("beta"), *curve, *slope)
        beta = settle(sums.mapInPandas(solve, f"{key} string, beta array<double>, _step double"))
        if (beta.agg(F.max("_step")).first()[0] or 0.0) <= tol:
            return beta.drop("_step")
    raise RuntimeError(f"count regression hasn't converged after {max_iter} steps")


def fc_count_glm(features: DataFrame, routes: DataFrame, future: DataFrame, *, prior_days: float = 28.0, max_iter: int = 100) -> DataFrame:
    """Count forecasts on weekday, price and snap: per series, or pooled with shrunken levels.

    ``features`` has ``unique_id, y, dayofweek, price_norm, snap``; ``routes`` says which series
    share a pool. A pooled series keeps its own level, drawn towards the pool by ``prior_days``
    days of pool-average demand.
    """
    key = F.when(F.col("route") == "pooled", F.concat(F.lit("pool:"), "pool")).otherwise(F.concat(F.lit("id:"), "unique_id"))
    keyed = features.join(routes.select("unique_id", key.alias("_key")), "unique_id")
    covariates = ["dayofweek", "price_norm", "snap"]
    cells = settle(keyed.groupBy("_key", *covariates).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y")))
    beta = fit_count_glm(cells, "_key", max_iter=max_iter)
    x = _count_terms()
    eta = sum((F.element_at("beta", i + 1) * x[i] for i in range(_COUNT_TERMS)), F.lit(0.0))
    mean = F.exp(F.least(eta, F.lit(30.0)))
    per_series = keyed.groupBy("unique_id", "_key", *covariates).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    expected = per_series.join(beta, "_key").groupBy("unique_id", "_key").agg(
        F.sum("y").alias("_y"), F.sum(F.col("n") * mean).alias("_e"), F.sum("n").alias("_n")
    )
    prior = prior_days * F.col("_e") / F.col("_n")
    level = expected.select("unique_id", "_key", ((F.col("_y") + prior) / F.greatest(F.col("_e") + prior, F.lit(1e-9))).alias("_level"))
    rows = future.join(level, "unique_id").join(beta, "_key")
    return rows.select("unique_id", "ds", (F.col("_level") * mean).alias("CountGLM"))
