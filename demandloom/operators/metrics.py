"""Error metrics and the components (weights, scales) of the weighted scaled error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.expr import ratio, revenue, smape_term, weighted
from demandloom.operators.reshape import models_long
from demandloom.session import settle

TRAILING_ROWS = 28
SERIES_FLOOR = 1e-9
POOLED_FLOOR = 1e-8

def error() -> Column:
    """Forecast minus truth."""
    return F.col("y_hat") - F.col("y")


def series_components(train: DataFrame, by: Sequence[str] = ("unique_id",), price: str | None = "sell_price") -> DataFrame:
    """Per series the revenue of its last 28 rows and the mean squared and absolute first difference.

    One ordered pass per series: the trailing revenue is a moving sum whose value on the last
    row is wanted, so no second (descending) sort is made.
    """
    ordered = W.partitionBy(*by).orderBy("ds")
    step = F.col("y") - F.lag("y").over(ordered)
    value = revenue(train, price=price) if "_rev" not in train.columns else F.col("_rev")
    rows = train.withColumns({"_value": value, "_step": step})
    trailing = F.sum("_value").over(ordered.rowsBetween(-(TRAILING_ROWS - 1), 0))
    return (
        rows.withColumn("_trailing", trailing)
        .groupBy(*by)
        .agg(
            F.max_by("_trailing", "ds").alias("trailing_revenue"),
            F.avg(F.col("_step") * F.col("_step")).alias("scale"),
            F.avg(F.abs("_step")).alias("abs_scale"),
        )
    )


def wrmsse_components(train: DataFrame, price: str | None = "sell_price") -> DataFrame:
    """``unique_id, weight, scale``: revenue share of the last 28 rows, squared-difference scale."""
    return components_of(settle(series_components(train, price=price)))


def components_of(per_series: DataFrame) -> DataFrame:
    """Weights and scales from the (settled) per-series table.

    Series with scale 0 are dropped after the shares are taken; a null scale (a single row) is
    kept.
    """
    total = F.lit(per_series.agg(F.sum("trailing_revenue")).first()[0])
    return per_series.where(F.col("scale").isNull() | (F.col("scale") != 0)).select(
        "unique_id", ratio(F.col("trailing_revenue"), total).alias("weight"), "scale"
    )


def naive_scale(train: DataFrame, season: int = 1, by: Sequence[str] = ("unique_id",), out: str = "naive_scale") -> DataFrame:
    """Mean absolute seasonal difference per series; undefined or zero scales are dropped."""
    step = F.abs(F.col("y") - F.lag("y", season).over(W.partitionBy(*by).orderBy("ds")))
    scale = train.withColumn("_d", step).groupBy(*by).agg(F.avg("_d").alias(out))
    return scale.where(F.col(out) > 0)


def squared_error_by(long: DataFrame, *by: str) -> DataFrame:
    """Mean squared error per (by..., model, series)."""
    return long.groupBy(*by, "model", "unique_id").agg(F.avg(error() * error()).alias("mse"))


def rmsse() -> Column:
    return F.sqrt(ratio(F.col("mse"), F.col("scale")))


def wrmsse_by(long: DataFrame, components: DataFrame, *by: str) -> DataFrame:
    """WRMSSE per (by..., model). Raises nothing for empty overlap: no rows come out."""
    scored = squared_error_by(long, *by).join(components, "unique_id")
    return scored.groupBy(*by, "model").agg(F.coalesce(F.sum(F.col("weight") * rmsse()), F.lit(0.0)).alias("wrmsse"))


def wrmsse(truth: DataFrame, forecast: DataFrame, components: DataFrame, forecast_col: str = "y_hat") -> DataFrame:
    """One-row score of one forecast column against a truth frame.

    Checks the overlap like every loader does: no shared rows or no shared series is an error.
    """
    keys = ["unique_id", "ds"] + (["cutoff"] if "cutoff" in truth.columns and "cutoff" in forecast.columns else [])
    pairs = truth.select(*keys, "y").join(forecast.select(*keys, F.col(forecast_col).alias("y_hat")), keys)
    per_series = settle(pairs.groupBy("unique_id").agg(F.avg(error() * error()).alias("mse")))
    if per_series.isEmpty():
        raise ValueError("no overlapping rows between truth and forecast")
    scored = per_series.join(components, "unique_id")
    if scored.isEmpty():
        raise ValueError("components share no series with the forecast")
    return scored.agg(F.coalesce(F.sum(F.col("weight") * rmsse()), F.lit(0.0)).alias("wrmsse"))


def wrmsse_for_models(cv: DataFrame, components: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """``model, wrmsse`` for every forecast column, best first."""
    return wrmsse_by(models_long(cv, models), components).orderBy("wrmsse", "model")


def accuracy_for_models(cv: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Pooled MAE, RMSE, sMAPE, bias and bias over mean |y| per model."""
    y, y_hat = F.col("y"), F.col("y_hat")
    return (
        models_long(cv, models)
        .groupBy("model")
        .agg(
            F.avg(F.abs(error())).alias("MAE"),
            F.sqrt(F.avg(error() * error())).alias("RMSE"),
            F.avg(smape_term(y, y_hat, POOLED_FLOOR)).alias("sMAPE"),
            F.avg(error()).alias("bias"),
            F.coalesce(ratio(F.avg(error()), F.avg(F.abs(y))), F.lit(0.0)).alias("bias_pct_of_mean_y"),
            F.count("*").alias("n_obs"),
        )
        .orderBy("MAE", "model")
    )


def conventional_metrics(cv: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Variant that skips nulls, calls 0/0 a zero sMAPE and divides the bias by the signed mean.

    The mean of y covers all rows with a truth, also those a model did not forecast.
    """
    size = F.abs("y") + F.abs("y_hat")
    known = F.col("y_hat").isNotNull()
    return (
        models_long(cv.where(F.col("y").isNotNull()), models)
        .groupBy("model")
        .agg(
            F.count(F.when(known, 1)).alias("n_obs"),
            F.avg(F.abs(error())).alias("MAE"),
            F.sqrt(F.avg(error() * error())).alias("RMSE"),
            F.avg(F.when(size > 0, 2 * F.abs(error()) / size).when(known, 0.0)).alias("sMAPE"),
            F.avg(error()).alias("bias_mean_residual"),
            ratio(F.avg(error()), F.avg("y")).alias("bias_pct_of_mean_y"),
        )
        .orderBy("RMSE", "model")
    )


def per_series_metrics(long: DataFrame, scales: DataFrame | None = None, *by: str) -> DataFrame:
    """rmse, mae, smape, signed bias, n_obs and (with scales) mase per (by..., model, series)."""
    out = long.groupBy(*by, "model", "unique_id").agg(
        F.sqrt(F.avg(error() * error())).alias("rmse"),
        F.avg(F.abs(error())).alias("mae"),
        F.avg(smape_term(F.col("y"), F.col("y_hat"), SERIES_FLOOR)).alias("smape"),
        F.avg(error()).alias("bias"),
        F.count("*").alias("n_obs"),
    )
    if scales is None:
        return out
    return out.join(scales, "unique_id", "left").withColumn("mase", ratio(F.col("mae"), F.col("naive_scale"))).drop("naive_scale")


def aggregate_series_metrics(per_series: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Mean over the series per model, plain or weighted with weights renormalised."""
    cols = [c for c in ("rmse", "mae", "smape", "bias", "mase") if c in per_series.columns]
    if weights is None:
        return per_series.groupBy("model").agg(*[F.avg(c).alias(c) for c in cols])
    joined = per_series.join(weights.select("unique_id", "weight"), "unique_id")
    return joined.groupBy("model").agg(*[weighted(F.col(c), F.col("weight")).alias(c) for c in cols])


def wmape_bias_pct(long: DataFrame, *by: str) -> DataFrame:
    """Sum of |e| over sum of |y|, and sum of e over |sum of y|."""
    floor = F.lit(SERIES_FLOOR)
    return long.groupBy(*by, "model").agg(
        (F.sum(F.abs(error())) / F.greatest(F.sum(F.abs("y")), floor)).alias("wmape"),
        (F.sum(error()) / F.greatest(F.abs(F.sum("y")), floor)).alias("bias_pct"),
    )


def per_series_rmsse(cv: DataFrame, components: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """RMSSE per (model, series)."""
    return squared_error_by(models_long(cv, models).dropna(subset=["y", "y_hat"])).join(components, "unique_id").select(
        "model", "unique_id", rmsse().alias("rmsse")
    )


def worst_n_series(per_series: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` series with the largest RMSSE per model.

    The rank filter is pushed below the shuffle as a per-task top-n, so a model's series are
    never gathered in one task.
    """
    order = W.partitionBy("model").orderBy(F.desc_nulls_last("rmsse"), "unique_id")
    return per_series.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def per_series_wrmsse_delta(cv: DataFrame, components: DataFrame, left: str, right: str) -> DataFrame:
    """Single-series score (its own weight is 1) of two models and their difference."""
    wide = (
        per_series_rmsse(cv, components, [left, right])
        .groupBy("unique_id")
        .agg(*[F.max(F.when(F.col("model") == m, F.col("rmsse"))).alias(m) for m in (left, right)])
    )
    return wide.withColumn("delta", F.col(f"`{left}`") - F.col(f"`{right}`")).orderBy("delta", "unique_id")
