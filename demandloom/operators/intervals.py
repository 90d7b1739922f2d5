"""Split conformal prediction intervals from backtest residuals (truth minus forecast)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.expr import need
from demandloom.functions.ordered import exact_quantiles

METHODS = ("pooled", "grouped", "scaled")
MAX_SCALE = 5.0


def cv_residuals(cv: DataFrame, model: str) -> DataFrame:
    """Backtest rows with horizon step and residual y - y_hat."""
    return cv.select(
        "unique_id", "ds", "cutoff", "y", F.col(f"`{model}`").alias(model),
        F.datediff("ds", "cutoff").alias("step"), (F.col("y") - F.col(f"`{model}`")).alias("residual"),
    )


def step_quantiles(cv: DataFrame, model: str, alphas: Sequence[float], *by: str) -> DataFrame:
    """``by..., step, alpha, q``: the (1 - alpha) quantile of |residual|, all alphas in one go."""
    rows = cv.select(*by, F.datediff("ds", "cutoff").alias("step"), F.abs(F.col("y") - F.col(f"`{model}`")).alias("_abs"))
    probs = [1 - a for a in alphas]
    alpha_of = F.element_at(
        F.create_map(*[F.lit(v) for p, a in zip(probs, alphas, strict=True) for v in (float(p), float(a))]), F.col("p")
    )
    return exact_quantiles(rows, [*by, "step"], "_abs", probs).select(*by, "step", alpha_of.alias("alpha"), "q")


@dataclass
class ConformalState:
    """Fitted half-widths: per step, optionally per (group, step), and the mean forecast."""

    model: str
    method: str
    alpha: float
    pooled: DataFrame
    grouped: DataFrame | None = None
    group_col: str | None = None
    mean_forecast: DataFrame | None = None


def conformal_fit(
    cv: DataFrame,
    model: str,
    *,
    alpha: float = 0.1,
    method: str = "pooled",
    group_col: str | None = None,
    min_group_size: int = 50,
    enforce_min_group: bool = False,
) -> ConformalState:
    """Calibrate the half-widths of one model.

    ``enforce_min_group`` drops group quantiles that rest on fewer than ``min_group_size``
    residuals, so such groups fall back to the pooled width; by default every group counts.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, use one of {METHODS}")
    pooled = step_quantiles(cv, model, [alpha]).select("step", "q")
    if method == "scaled":
        return ConformalState(model, method, alpha, pooled, mean_forecast=cv.agg(F.avg(F.col(f"`{model}`")).alias("mean_forecast")))
    if method == "pooled":
        return ConformalState(model, method, alpha, pooled)
    if not group_col or group_col not in cv.columns:
        raise ValueError(f"method 'grouped' needs a group column of the frame, got {group_col!r}")
    grouped = step_quantiles(cv, model, [alpha], group_col).select(group_col, "step", "q")
    if enforce_min_group:
        sizes = cv.groupBy(group_col, F.datediff("ds", "cutoff").alias("step")).agg(F.count("*").alias("_n"))
        grouped = grouped.join(sizes, [group_col, "step"]).where(F.col("_n") >= min_group_size).drop("_n")
    return ConformalState(model, method, alpha, pooled, grouped, group_col)


def _with_step(df: DataFrame) -> DataFrame:
    if "cutoff" in df.columns:
        return df.withColumn("_step", F.datediff("ds", "cutoff"))
    return df.withColumn("_step", F.row_number().over(W.partitionBy("unique_id").orderBy("ds")))


def _bounds(df: DataFrame, col: str, half: Column) -> DataFrame:
    y_hat = F.col(f"`{col}`")
    low = F.when((y_hat - half).isNotNull(), F.greatest(y_hat - half, F.lit(0.0)))
    return df.withColumns({f"{col}_lo": low, f"{col}_hi": y_hat + half})


def conformal_apply(state: ConformalState, forecast: DataFrame, forecast_col: str | None = None) -> DataFrame:
    """Forecast with ``<col>_lo`` (not below 0) and ``<col>_hi``.

    The step is the distance to the cutoff, or the position in the series without one. The
    step table has one row per horizon step, hence the broadcast.
    """
    col = forecast_col or state.model
    need(forecast, "unique_id", "ds", col)
    pooled = state.pooled.select(F.col("step").alias("_step"), F.col("q").alias("_q"))
    out = _with_step(forecast).join(F.broadcast(pooled), "_step", "left")
    half = F.col("_q")
    if state.method == "scaled" and state.mean_forecast is not None:
        mean = F.greatest(state.mean_forecast.scalar(), F.lit(1e-8))
        scale = F.sqrt(F.greatest(F.col(f"`{col}`"), F.lit(0.0)) / mean)
        half = half * F.least(scale, F.lit(MAX_SCALE))
    if state.method == "grouped" and state.grouped is not None and state.group_col in forecast.columns:
        by_group = state.grouped.select(state.group_col, F.col("step").alias("_step"), F.col("q").alias("_gq"))
        out = out.join(by_group, [state.group_col, "_step"], "left")
        half = F.coalesce(F.col("_gq"), half)
    return _bounds(out, col, half).drop("_step", "_q", "_gq")


def interval_coverage(frame: DataFrame, col: str, *by: Column | str) -> DataFrame:
    """Share of rows whose truth is inside, and the mean width."""
    lo, hi = F.col(f"`{col}_lo`"), F.col(f"`{col}_hi`")
    inside = F.coalesce((F.col("y") >= lo) & (F.col("y") <= hi), F.lit(False)).cast("double")
    return frame.groupBy(*by).agg(F.avg(inside).alias("coverage"), F.avg(hi - lo).alias("avg_width"))


def coverage_by_step(frame: DataFrame, col: str) -> DataFrame:
    return interval_coverage(frame, col, F.datediff("ds", "cutoff").alias("step"))


def method_compare(cv: DataFrame, model: str, alpha: float = 0.1, methods: Sequence[str] = ("pooled", "scaled")) -> DataFrame:
    """Coverage and width of the calibration methods side by side."""
    out = None
    for method in methods:
        row = interval_coverage(conformal_apply(conformal_fit(cv, model, alpha=alpha, method=method), cv), model)
        row = row.select(F.lit(method).alias("method"), "coverage", "avg_width")
        out = row if out is None else out.unionByName(row)
    return out


def alpha_sweep(cv: DataFrame, model: str, alphas: Sequence[float]) -> DataFrame:
    """Coverage and width of the pooled method for many alphas in one pass.

    Steps x alphas half-widths are a bounded table, gathered to one array per step.
    """
    widths = step_quantiles(cv, model, alphas).groupBy("step").agg(F.collect_list(F.struct("alpha", "q")).alias("_w"))
    rows = cv.withColumn("step", F.datediff("ds", "cutoff")).join(F.broadcast(widths), "step")
    y_hat = F.col(f"`{model}`")
    half = rows.select("y", y_hat.alias("_f"), F.inline("_w"))
    low = F.greatest(F.col("_f") - F.col("q"), F.lit(0.0))
    inside = ((F.col("y") >= low) & (F.col("y") <= F.col("_f") + F.col("q"))).cast("double")
    return half.groupBy("alpha").agg(F.avg(inside).alias("coverage"), F.avg(F.col("_f") + F.col("q") - low).alias("avg_width"))
