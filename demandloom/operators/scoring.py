"""Score axes: headline, fold, horizon, segment, level. All read one unpivoted error frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.expr import forecast_columns, need, ratio, revenue, weighted
from demandloom.operators.hierarchy import LEVELS, PLACE_PRODUCT, PLAIN_LEVELS, level_history, level_weights, roll_up
from demandloom.operators.metrics import (
    components_of,
    conventional_metrics,
    error,
    per_series_metrics,
    rmsse,
    series_components,
    squared_error_by,
    wmape_bias_pct,
    wrmsse_by,
)
from demandloom.operators.reshape import latest, models_long
from demandloom.session import settle

SEGMENTS = ("state_id", "store_id", "cat_id", "dept_id")


@dataclass
class ScoringInputs:
    """A wide backtest frame with everything the axes need around it.

    ``train`` holds the rows before the first test day; ``train_end`` may name its last day
    when that is known without a scan. The per-series training table is computed once, on first
    use, and shared by all axes.
    """

    cv: DataFrame
    train: DataFrame
    statics: DataFrame
    models: list[str] = field(default_factory=list)
    train_end: Column | None = None

    @classmethod
    def build(cls, cv: DataFrame, panel: DataFrame, statics: DataFrame, first_test: Column | None = None) -> ScoringInputs:
        start = first_test if first_test is not None else F.lit(cv.agg(F.min("ds")).first()[0])
        return cls(cv, panel.where(F.col("ds") < start), statics, forecast_columns(cv), F.date_sub(start, 1))

    @property
    def long(self) -> DataFrame:
        return models_long(self.cv, self.models)

    @cached_property
    def series(self) -> DataFrame:
        """Trailing revenue and difference scales per training series."""
        return settle(series_components(self.train))

    @cached_property
    def components(self) -> DataFrame:
        return components_of(self.series)

    @property
    def scales(self) -> DataFrame:
        """Absolute-difference scale of the series where it is defined and not zero."""
        return self.series.where(F.col("abs_scale") > 0).select("unique_id", F.col("abs_scale").alias("naive_scale"))


def score_headline(inp: ScoringInputs) -> DataFrame:
    """Per model WRMSSE and the weighted series metrics, best first; one pass over the errors."""
    ps = per_series_metrics(inp.long, inp.scales).join(inp.components, "unique_id")
    scaled = F.sqrt(ratio(F.col("rmse") * F.col("rmse"), F.col("scale")))
    return (
        ps.groupBy("model")
        .agg(
            F.coalesce(F.sum(F.col("weight") * scaled), F.lit(0.0)).alias("wrmsse"),
            *[weighted(F.col(c), F.col("weight")).alias(c) for c in ("rmse", "mae", "smape", "bias", "mase")],
        )
        .orderBy("wrmsse", "model")
    )


def score_headline_dash(inp: ScoringInputs) -> DataFrame:
    """Headline with wMAPE and relative bias."""
    return score_headline(inp).join(wmape_bias_pct(inp.long), "model").orderBy("wrmsse", "model")


def score_per_fold(inp: ScoringInputs) -> DataFrame:
    return wrmsse_by(inp.long, inp.components, "cutoff").select("model", "cutoff", "wrmsse")


def score_per_horizon(inp: ScoringInputs) -> DataFrame:
    long = inp.long.withColumn("h", F.datediff("ds", "cutoff"))
    return wrmsse_by(long, inp.components, "h").select("model", "h", "wrmsse").orderBy("model", "h")


def _attach(df: DataFrame, statics: DataFrame, cols: Sequence[str]) -> DataFrame:
    lacking = [c for c in cols if c not in df.columns]
    return df.join(statics.select("unique_id", *lacking), "unique_id", "left") if lacking else df


def _segment_scores(mse: DataFrame, components: DataFrame, by: Sequence[str]) -> DataFrame:
    """Segment score as a ratio of sums, so no weight has to be renormalised per row."""
    total = F.sum("weight")
    return (
        mse.join(components, "unique_id")
        .groupBy("model", *by)
        .agg(
            ratio(F.coalesce(F.sum(F.col("weight") * rmsse()), F.lit(0.0)), total).alias("wrmsse"),
            F.count("weight").alias("n_series"),
            total.alias("_total"),
        )
        .where(F.col("_total") != 0)
        .drop("_total")
    )


def score_per_segment(inp: ScoringInputs, segment_col: str) -> DataFrame:
    """WRMSSE inside each value of an attribute; no rows when the attribute is unknown."""
    if segment_col not in inp.statics.columns:
        return inp.cv.sparkSession.createDataFrame([], "model string, segment string, wrmsse double, n_series bigint")
    mse = squared_error_by(inp.long)
    mse = mse.join(inp.statics.select("unique_id", F.col(segment_col).cast("string").alias("segment")), "unique_id")
    return _segment_scores(mse.where(F.col("segment").isNotNull()), inp.components, ["segment"])


def score_segments_all(inp: ScoringInputs, axes: Sequence[str] = SEGMENTS) -> DataFrame:
    """All attribute axes with every metric, from one per-series aggregate exploded by axis."""
    axes = [a for a in axes if a in inp.statics.columns]
    tags = F.inline(F.array(*[F.struct(F.lit(a).alias("segment_axis"), F.col(a).cast("string").alias("segment")) for a in axes]))
    per = (
        per_series_metrics(inp.long, inp.scales)
        .join(_pooled_sums(inp.long), ["model", "unique_id"])
        .join(inp.statics.select("unique_id", *axes), "unique_id")
        .join(inp.components, "unique_id", "left")
    )
    exploded = per.select("*", tags).where(F.col("segment").isNotNull())
    known = F.col("weight").isNotNull()
    total = F.sum("weight")
    floor = F.lit(1e-9)
    scaled = F.sqrt(ratio(F.col("rmse") * F.col("rmse"), F.col("scale")))
    return (
        exploded.groupBy("model", "segment_axis", "segment")
        .agg(
            F.count(F.when(known, 1)).alias("n_series"),
            ratio(F.coalesce(F.sum(F.col("weight") * scaled), F.lit(0.0)), total).alias("wrmsse"),
            *[ratio(F.coalesce(F.sum(F.col("weight") * F.col(c)), F.lit(0.0)), total).alias(c) for c in ("rmse", "mae", "smape", "bias", "mase")],
            (F.sum("_abs_error") / F.greatest(F.sum("_abs_y"), floor)).alias("wmape"),
            (F.sum("_error") / F.greatest(F.abs(F.sum("_y")), floor)).alias("bias_pct"),
            total.alias("_total"),
        )
        .where(F.col("_total") > 0)
        .drop("_total")
    )


def _pooled_sums(long: DataFrame) -> DataFrame:
    return long.groupBy("model", "unique_id").agg(
        F.sum(F.abs(error())).alias("_abs_error"),
        F.sum(error()).alias("_error"),
        F.sum(F.abs("y")).alias("_abs_y"),
        F.sum("y").alias("_y"),
    )


# --- levels ---------------------------------------------------------------------------------

_LEVEL_KEY = ("level_idx", "level", "node")


def _level_train(inp: ScoringInputs, levels=LEVELS, names=None, node=None) -> DataFrame:
    train = _attach(inp.train, inp.statics, [c for c in PLACE_PRODUCT if any(c in lv for lv in levels)])
    train = train.withColumn("_rev", revenue(train))
    end = inp.train_end if inp.train_end is not None else latest(inp.train)
    return level_history(train, ["y", "_rev"], levels, end=end, names=names, node=node)


def level_components(inp: ScoringInputs) -> DataFrame:
    """``level_idx, level, node, weight, scale`` of the aggregated training series."""
    return level_weights(series_components(_level_train(inp), by=_LEVEL_KEY)).drop("abs_scale")


def _level_cv(inp: ScoringInputs, levels=LEVELS, names=None, node=None) -> DataFrame:
    """Truth and forecasts summed to every level, then unpivoted (after the roll-up: fewer rows)."""
    cv = _attach(inp.cv, inp.statics, [c for c in PLACE_PRODUCT if any(c in lv for lv in levels)])
    wide = roll_up(cv, ["y", *inp.models], ["cutoff", "ds"], levels, names, node)
    keys = ["level_idx", "level", "node", "cutoff", "ds", "y"]
    return wide.unpivot(keys, inp.models, "model", "y_hat")


def score_per_level(inp: ScoringInputs) -> DataFrame:
    """WRMSSE of every model at each of the twelve levels (bottom forecasts summed up)."""
    need(inp.statics, *PLACE_PRODUCT)
    components = level_components(inp)
    mse = _level_cv(inp).groupBy("level_idx", "node", "model").agg(F.avg(error() * error()).alias("mse"))
    scores = (
        mse.join(components.drop("level"), ["level_idx", "node"])
        .groupBy("model", "level_idx")
        .agg(F.sum(F.col("weight") * rmsse()).alias("wrmsse"))
    )
    counts = components.groupBy("level_idx", "level").agg(F.count("*").alias("n_series"))
    return scores.join(F.broadcast(counts), "level_idx").select("model", "level", "level_idx", "n_series", "wrmsse")


def score_levels_dash(inp: ScoringInputs) -> DataFrame:
    """Every metric at every level."""
    components = level_weights(series_components(_level_train(inp), by=_LEVEL_KEY)).drop("level")
    rows = _level_cv(inp)
    sums = {"_ae": F.abs(error()), "_e": error(), "_ay": F.abs("y"), "_sy": F.col("y")}
    per_node = (
        rows.groupBy("level_idx", "level", "node", "model")
        .agg(
            F.avg(error() * error()).alias("mse"),
            F.avg(F.abs(error())).alias("mae"),
            F.avg(2 * F.abs(error()) / F.greatest(F.abs("y") + F.abs("y_hat"), F.lit(1e-9))).alias("smape"),
            F.avg(error()).alias("bias"),
            *[F.sum(c).alias(n) for n, c in sums.items()],
        )
        .join(components, ["level_idx", "node"], "left")
        .withColumns({"rmse": F.sqrt("mse"), "mase": ratio(F.col("mae"), F.col("abs_scale"))})
    )
    floor = F.lit(1e-9)
    return per_node.groupBy("model", "level", "level_idx").agg(
        F.count("weight").alias("n_series"),
        F.sum(F.col("weight") * rmsse()).alias("wrmsse"),
        *[weighted(F.col(c), F.col("weight")).alias(c) for c in ("rmse", "mae", "smape", "bias", "mase")],
        (F.sum("_ae") / F.greatest(F.sum("_ay"), floor)).alias("wmape"),
        (F.sum("_e") / F.greatest(F.abs(F.sum("_sy")), floor)).alias("bias_pct"),
    )


def score_hier_notebook(inp: ScoringInputs) -> DataFrame:
    """Level scores with node weights summed from the bottom weights: ``level, model, wrmsse``.

    Scales come from the aggregated training series, weights from the series' own trailing
    revenue, so the two differ from :func:`score_per_level` where series end early.
    """
    specs = [cols for _, cols in PLAIN_LEVELS]
    names = [n for n, _ in PLAIN_LEVELS]
    node = F.concat_ws("|", *PLACE_PRODUCT)
    scales = series_components(_level_train(inp, specs, names, node), by=_LEVEL_KEY).where(F.col("scale") > 0)
    bottom = _attach(inp.series, inp.statics, PLACE_PRODUCT)
    weights = settle(roll_up(bottom, ["trailing_revenue"], [], specs, names, node))
    totals = weights.groupBy("level_idx").agg(F.sum("trailing_revenue").alias("_total"))
    weights = weights.join(F.broadcast(totals), "level_idx").select(
        "level_idx", "node", ratio(F.col("trailing_revenue"), F.col("_total")).alias("weight")
    )
    mse = _level_cv(inp, specs, names, node).groupBy("level_idx", "level", "node", "model").agg(F.avg(error() * error()).alias("mse"))
    return (
        mse.join(scales.select("level_idx", "node", "scale"), ["level_idx", "node"])
        .join(weights, ["level_idx", "node"])
        .groupBy("level", "model")
        .agg(F.sum(F.col("weight") * rmsse()).alias("wrmsse"))
    )


def score_summary(inp: ScoringInputs) -> DataFrame:
    """One wide row per model: bottom score, twelve levels, their mean, pooled metrics."""
    names = [n for n, _ in PLAIN_LEVELS]
    levels = score_hier_notebook(inp)
    wide = levels.groupBy("model").agg(
        F.avg("wrmsse").alias("WRMSSE_mean_12L"),
        *[F.max(F.when(F.col("level") == n, F.col("wrmsse"))).alias(f"WRMSSE_{n}") for n in names],
    )
    bottom = wrmsse_by(inp.long, inp.components).withColumnRenamed("wrmsse", "WRMSSE_bottom")
    pooled = conventional_metrics(inp.cv, inp.models).select("model", "MAE", "RMSE", "sMAPE", "bias_pct_of_mean_y")
    return bottom.join(wide, "model").join(pooled, "model").orderBy("WRMSSE_bottom", "model")


# Published twelve-level scores of the competition's first three places.
PUBLISHED_SCORES = (
    ("1st_place (YJ_STU)", 0.520),
    ("2nd_place (Anderer)", 0.528),
    ("3rd_place (mf)", 0.536),
)


def benchmark_compare(scores: DataFrame, column: str = "WRMSSE_mean_12L") -> DataFrame:
    """Own scores and the published ones, best first, with the gap to the best published."""
    published = scores.sparkSession.createDataFrame(list(PUBLISHED_SCORES), f"model string, {column} double")
    own = scores.select("model", column)
    best = min(v for _, v in PUBLISHED_SCORES)
    return own.union(published).withColumn("gap_to_first", F.col(column) - F.lit(best)).orderBy(column, "model")


def leaderboard_rank(scores: DataFrame, column: str = "wrmsse") -> DataFrame:
    """Rank of each model, ties sharing the smaller rank (a model-sized window)."""
    return scores.withColumn("rank", F.rank().over(W.partitionBy(F.lit(0)).orderBy(column)))


# Metrics ranked by distance from zero instead of by size.
SIGNED_METRICS = ("bias", "bias_pct")


def metric_rank(rows: DataFrame, metric: str = "wrmsse", ties: Sequence[str] = ("model",)) -> DataFrame:
    """Rows with a finite metric, ranked ascending; bias metrics by their absolute value.

    For score tables (models x axes), not for series.
    """
    key = F.abs(F.col(metric)) if metric in SIGNED_METRICS else F.col(metric)
    finite = F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(F.col(metric)) != float("inf"))
    return rows.where(finite).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key, *ties)))


def metric_filter(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that match every given (non-null) filter."""
    terms = [F.col(c) == v for c, v in wanted.items() if v]
    return rows.where(reduce(lambda a, b: a & b, terms)) if terms else rows


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values."""
    kept = rows.where(F.col(column).isNotNull() & (F.col(column).cast("string") != ""))
    return kept.select(column).distinct().orderBy(column)


def lift_vs_baseline(scores: DataFrame, baseline: str) -> DataFrame:
    """Percent WRMSSE lift over a named model, rounded as reported."""
    if scores.where(F.col("model") == baseline).isEmpty():
        raise ValueError(f"baseline {baseline!r} is not among the models")
    base = scores.where(F.col("model") == baseline).agg(F.max("wrmsse")).scalar()
    lift = ratio(base - F.col("wrmsse"), base) * 100
    return scores.select("model", F.round("wrmsse", 6).alias("wrmsse"), F.round(lift, 2).alias("lift")).orderBy("wrmsse", "model")


def cumulative_error(inp: ScoringInputs) -> DataFrame:
    """Running error, |error| and |y| by horizon step per model (a step-sized window)."""
    by_h = (
        inp.long.withColumn("h", F.datediff("ds", "cutoff"))
        .groupBy("model", "h")
        .agg(F.sum(error()).alias("_e"), F.sum(F.abs(error())).alias("_ae"), F.sum(F.abs("y")).alias("_ay"))
    )
    upto = W.partitionBy("model").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    return by_h.select(
        "model",
        "h",
        F.sum("_e").over(upto).alias("cum_error"),
        F.sum("_ae").over(upto).alias("cum_abs_error"),
        F.sum("_ay").over(upto).alias("cum_actual"),
    ).withColumn("cum_error_pct", F.col("cum_error") / F.greatest("cum_actual", F.lit(1e-9)))
