"""Intermittency profiles and routing, exploratory aggregates, batch forecast requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.expr import ratio
from demandloom.operators.folds import baseline_forecast
from demandloom.operators.reshape import keep_series, top_n_series

ADI_THRESHOLD = 1.32
CV2_THRESHOLD = 0.49
POOLED_CLASSES = ("intermittent", "lumpy")


def intermittency_profile(panel: DataFrame) -> DataFrame:
    """Average demand interval, squared variation of the non-zero demand, zero rate and class."""
    sold = F.when(F.col("y") > 0, F.col("y"))
    per = panel.groupBy("unique_id").agg(
        ratio(F.count("*"), F.count(sold)).alias("adi"),
        F.pow(ratio(F.stddev_pop(sold), F.avg(sold)), 2).alias("cv2"),
        F.avg((F.col("y") == 0).cast("double")).alias("zero_rate"),
    )
    rare, wild = F.col("adi") >= ADI_THRESHOLD, F.col("cv2") >= CV2_THRESHOLD
    kind = (
        F.when(F.col("adi").isNull(), "no_demand")
        .when(~rare & ~wild, "smooth")
        .when(~rare, "erratic")
        .when(~wild, "intermittent")
        .otherwise("lumpy")
    )
    return per.withColumn("demand_class", kind)


def demand_route(profile: DataFrame, pools: DataFrame, pool_col: str) -> DataFrame:
    """Sparse series with at least one sparse peer in their pool are modelled together."""
    pooled = profile.join(pools.select("unique_id", F.col(pool_col).alias("pool")), "unique_id")
    sparse = F.col("demand_class").isin(*POOLED_CLASSES)
    peers = pooled.where(sparse).groupBy("pool").agg(F.count("*").alias("peers"))
    routed = pooled.join(peers, "pool", "left")
    route = F.when(sparse & (F.col("peers") >= 2), "pooled").otherwise("univariate")
    return routed.select("unique_id", "pool", "demand_class", F.coalesce("peers", F.lit(0)).alias("peers"), route.alias("route"))


def route_mix(routes: DataFrame) -> DataFrame:
    """Class x route counts."""
    mix = routes.groupBy("demand_class").pivot("route", ["pooled", "univariate"]).count()
    return mix.na.fill(0)


def zero_rate_extremes(profile: DataFrame) -> DataFrame:
    """The series with the highest and the lowest zero rate."""
    top = profile.agg(F.min(F.struct((-F.col("zero_rate")).alias("k"), "unique_id", "zero_rate")).alias("x"))
    low = profile.agg(F.min(F.struct("zero_rate", "unique_id")).alias("x"))
    return top.select(F.lit("highest").alias("kind"), "x.unique_id", "x.zero_rate").union(
        low.select(F.lit("lowest"), "x.unique_id", "x.zero_rate")
    )


# --- exploratory aggregates ------------------------------------------------------------------


def eda_levels(panel: DataFrame, axes: Sequence[str] = ("state_id", "store_id", "cat_id", "dept_id")) -> DataFrame:
    """Daily sums for the total and each value of the axes: ``axis, value, ds, y`` in one pass."""
    sets = [[F.col("ds")], *[[F.col(a), F.col("ds")] for a in axes]]
    grouped = panel.groupingSets(sets, *[F.col(c) for c in (*axes, "ds")]).agg(
        F.sum("y").alias("y"), *[F.grouping(a).alias(f"_g_{a}") for a in axes]
    )
    axis = F.lit("total")
    for a in axes:
        axis = F.when(F.col(f"_g_{a}") == 0, F.lit(a)).otherwise(axis)
    return grouped.select(axis.alias("axis"), F.coalesce(*axes, F.lit("total")).alias("value"), "ds", "y")


def eda_price_hist(prices: DataFrame, category: str, bins: int = 30) -> DataFrame:
    """Histogram of log(1 + price) per category with equal-width bins over its own range."""
    rows = prices.where(F.col("sell_price").isNotNull()).select(F.col(category).alias("category"), F.log1p("sell_price").alias("_v"))
    span = rows.groupBy("category").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.floor(ratio(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins).cast("int")
    return (
        rows.join(span, "category")
        .groupBy("category", F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def eda_calendar_effects(panel: DataFrame) -> DataFrame:
    """Mean y by weekday, by day of December, and Christmas against the rest: ``effect, key, mean_y``."""
    daily = panel.groupBy("ds").agg(F.sum("y").alias("_s"), F.count("*").alias("_n"))
    month, day = F.month("ds"), F.dayofmonth("ds")
    tags = F.array(
        F.struct(F.lit("weekday").alias("effect"), F.date_format("ds", "EEEE").alias("key")),
        F.struct(F.lit("december_day").alias("effect"), F.when(month == 12, day.cast("string")).alias("key")),
        F.struct(F.lit("christmas").alias("effect"), F.when((month == 12) & (day == 25), "xmas").otherwise("other").alias("key")),
    )
    tagged = daily.select("_s", "_n", F.inline(tags)).where(F.col("key").isNotNull())
    return tagged.groupBy("effect", "key").agg((F.sum("_s") / F.sum("_n")).alias("mean_y"))


def eda_rolling_mean(panel: DataFrame, top: int = 6, window: int = 7) -> DataFrame:
    """Rolling mean of the busiest series; null until the window is full."""
    frame = W.partitionBy("unique_id").orderBy("ds").rowsBetween(-(window - 1), 0)
    rows = keep_series(panel, top_n_series(panel, top))
    mean = F.when(F.count("y").over(frame) == window, F.avg("y").over(frame))
    return rows.select("unique_id", "ds", "y", mean.alias("rolling_mean"))


def panel_overview(panel: DataFrame) -> DataFrame:
    """Rows, series, days and date range.

    Series are counted from a per-series aggregate; distinct days are calendar-sized.
    """
    per = panel.groupBy("unique_id").agg(F.count("*").alias("n"), F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    days = panel.select("ds").distinct().agg(F.count("*").alias("n_days"))
    whole = per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_series"), F.min("lo").alias("min_ds"), F.max("hi").alias("max_ds"))
    return whole.withColumn("n_days", days.scalar())


# --- batch scoring of forecast requests ------------------------------------------------------

MIN_HISTORY = 55  # max(28 + 28 - 1, 28): rows a lag/rolling model needs


def request_rejects_by_id(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requested ids without stored history."""
    ids = requests.select("unique_id").distinct()
    return ids.join(known.select("unique_id").distinct(), "unique_id", "left_anti").withColumn("reason", F.lit("unknown_id"))


def score_requests_by_id(requests: DataFrame, history: DataFrame, h: int) -> DataFrame:
    """Forecasts for the de-duplicated known ids from stored history."""
    ids = requests.select("unique_id").distinct()
    return baseline_forecast(keep_series(history, ids), h).select("unique_id", "ds", F.col("Naive").alias("y_hat"))


def score_requests_history(request_history: DataFrame, statics: DataFrame, h: int, min_rows: int = MIN_HISTORY) -> DataFrame:
    """Forecasts from the caller's own history, for known series with enough rows.

    Every series starts from its own last day. Statics are attached for models that use them.
    """
    rejects = validate_requests(request_history, statics, min_rows=min_rows)
    good = request_history.join(rejects.select("unique_id"), "unique_id", "left_anti")
    last = good.groupBy("unique_id").agg(F.max("ds").alias("_d"), F.max_by("y", "ds").alias("y_hat"))
    steps = last.select("unique_id", "y_hat", F.explode(F.sequence(F.date_add("_d", 1), F.date_add("_d", h))).alias("ds"))
    return steps.join(statics, "unique_id").select("unique_id", "ds", "y_hat", *[c for c in statics.columns if c != "unique_id"])


def validate_requests(history: DataFrame, known: DataFrame, *, min_rows: int = MIN_HISTORY) -> DataFrame:
    """Rejected ids with a reason: blank id, negative y, too few rows, unknown series."""
    per = history.groupBy("unique_id").agg(F.count("ds").alias("n_rows"), F.min("y").alias("_lo"))
    ids = known.select("unique_id", F.lit(True).alias("_known")).distinct()
    checks = F.array_compact(
        F.array(
            F.when(F.trim(F.col("unique_id")) == "", F.lit("blank_id")),
            F.when(F.col("_lo") < 0, F.lit("negative_y")),
            F.when(F.col("n_rows") < min_rows, F.lit("short_history")),
            F.when(F.col("_known").isNull(), F.lit("unknown_id")),
        )
    )
    joined = per.join(ids, "unique_id", "left").withColumn("reasons", checks).where(F.size("reasons") > 0)
    return joined.select("unique_id", "n_rows", F.array_join("reasons", ",").alias("reasons"))


def batch_limits(history: DataFrame, horizon: int, *, max_horizon: int, max_series: int, max_rows: int) -> DataFrame:
    """Batch-level rejects: horizon, series count and history size above their caps."""
    per = history.groupBy("unique_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("series"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    checks = F.array(
        F.struct(F.lit("horizon").alias("check"), F.lit(horizon).cast("bigint").alias("value"), F.lit(max_horizon).cast("bigint").alias("cap")),
        F.struct(F.lit("series").alias("check"), F.col("series").alias("value"), F.lit(max_series).cast("bigint").alias("cap")),
        F.struct(F.lit("history_rows").alias("check"), F.col("rows").alias("value"), F.lit(max_rows).cast("bigint").alias("cap")),
    )
    return per.select(F.inline(checks)).withColumn("rejected", F.col("value") > F.col("cap"))
