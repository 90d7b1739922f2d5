"""Forecast value added: error of a reference minus error of a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.expr import weighted
from demandloom.operators.metrics import per_series_metrics, rmsse, squared_error_by
from demandloom.operators.scoring import ScoringInputs

# The metrics a value-added table may be based on.
BASES = ("mae", "rmse", "smape", "wrmsse")


def scalar_metric(inp: ScoringInputs, metric: str, *by: str) -> DataFrame:
    """One weighted number per (by..., model): ``by..., model, error``.

    Weights are renormalised over the shared series for mae, rmse and smape, and used as they
    are for wrmsse.
    """
    if metric not in BASES:
        raise ValueError(f"unknown metric {metric!r}, use one of {BASES}")
    if metric == "wrmsse":
        scored = squared_error_by(inp.long, *by).join(inp.components, "unique_id")
        value = F.coalesce(F.sum(F.col("weight") * rmsse()), F.lit(0.0))
    else:
        scored = per_series_metrics(inp.long, None, *by).join(inp.components, "unique_id")
        value = weighted(F.col(metric), F.col("weight"))
    return scored.groupBy(*by, "model").agg(value.alias("error"))


def _known(inp: ScoringInputs, *models: str) -> None:
    missing = [m for m in models if m not in inp.models]
    if missing:
        raise ValueError(f"not among the models {inp.models}: {missing}")


def fva_star(inp: ScoringInputs, baseline: str, metric: str = "mae") -> DataFrame:
    """Every other model against one baseline, largest gain first.

    The baseline error is spread over the model rows by a window of model size.
    """
    _known(inp, baseline)
    errors = scalar_metric(inp, metric)
    base = F.max(F.when(F.col("model") == baseline, F.col("error"))).over(W.partitionBy(F.lit(0)))
    out = errors.withColumn("error_baseline", base).where(F.col("model") != baseline)
    gain = F.col("error_baseline") - F.col("error")
    return out.select(
        "model",
        F.lit(baseline).alias("baseline"),
        F.lit(metric).alias("metric"),
        "error_baseline",
        F.col("error").alias("error_model"),
        gain.alias("fva_abs"),
        F.when(F.col("error_baseline") > 0, gain / F.col("error_baseline")).alias("fva_pct"),
    ).orderBy(F.desc("fva_abs"), "model")


def fva_chain(inp: ScoringInputs, chain: Sequence[str], metric: str = "mae") -> DataFrame:
    """Each step of an ordered list against the step before; the first row is the baseline."""
    _known(inp, *chain)
    if len(chain) < 2:
        raise ValueError("a chain needs at least two steps")
    place = F.array_position(F.array(*[F.lit(c) for c in chain]), F.col("model"))
    steps = scalar_metric(inp, metric).withColumn("pos", place).where(F.col("pos") > 0)
    order = W.partitionBy(F.lit(0)).orderBy("pos")
    before = F.lag("error").over(order)
    gain = before - F.col("error")
    first = F.col("pos") == 1
    return steps.select(
        F.col("pos").cast("int").alias("pos"),
        F.col("model").alias("step"),
        F.coalesce(F.lag("model").over(order), F.lit("")).alias("previous"),
        F.lit(metric).alias("metric"),
        before.alias("error_previous"),
        F.col("error").alias("error_step"),
        F.when(first, 0.0).otherwise(gain).alias("fva_abs"),
        F.when(first, 0.0).when(before > 0, gain / before).alias("fva_pct"),
        first.alias("is_baseline"),
    )


def fva_per_fold(inp: ScoringInputs, baseline: str, metric: str = "mae") -> DataFrame:
    """Star mode per cutoff."""
    _known(inp, baseline)
    errors = scalar_metric(inp, metric, "cutoff")
    base = F.max(F.when(F.col("model") == baseline, F.col("error"))).over(W.partitionBy("cutoff"))
    return (
        errors.withColumn("error_baseline", base)
        .where((F.col("model") != baseline) & F.col("error_baseline").isNotNull())
        .select(
            "model",
            F.lit(baseline).alias("baseline"),
            "cutoff",
            F.lit(metric).alias("metric"),
            "error_baseline",
            F.col("error").alias("error_model"),
            (F.col("error_baseline") - F.col("error")).alias("fva_abs"),
        )
    )


def fva_consistency(per_fold: DataFrame) -> DataFrame:
    """Share of folds with a gain, and the mean gain, per model."""
    gained = F.avg((F.col("fva_abs") > 0).cast("double"))
    return per_fold.groupBy("model").agg(gained.alias("share_positive"), F.avg("fva_abs").alias("mean_fva"), F.count("*").alias("n_folds"))


