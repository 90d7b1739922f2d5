"""Feature columns of the long panel: calendar, price, encodings, lags.

Windows are all per series (at most one row per day), except where a group could grow with the
number of series; those are computed from counts or aggregates and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from demandloom.functions.expr import ratio, week_of_year
from demandloom.session import settle

NO_EVENT = 999
SNAP_STATES = ("CA", "TX", "WI")
ENCODING_KEYS = {
    "cat_id_mean_dow": ("cat_id",),
    "dept_id_mean_dow": ("dept_id",),
    "store_id_mean_dow": ("store_id",),
    "state_id_mean_dow": ("state_id",),
    "store_cat_mean_dow": ("store_id", "cat_id"),
}
DYNAMIC_COLUMNS = (
    "snap", "is_event", "price_norm", "price_change_pct", "days_to_next_event",
    "days_since_last_event", "week_of_month", "price_mean", "price_min", "price_max",
    "price_rank_in_store", "days_since_release", *ENCODING_KEYS,
)

def _series() -> WindowSpec:
    return W.partitionBy("unique_id")


def _ordered() -> WindowSpec:
    return W.partitionBy("unique_id").orderBy("ds")


def feat_date(df: DataFrame, ds: str = "ds", *, iso_week: bool = False) -> DataFrame:
    """dayofweek (0 = Monday), day, week, month, year, is_weekend."""
    d = F.col(ds)
    weekday = F.weekday(d)
    return df.withColumns(
        {
            "dayofweek": weekday,
            "day": F.dayofmonth(d),
            "week": F.weekofyear(d) if iso_week else week_of_year(d),
            "month": F.month(d),
            "year": F.year(d),
            "is_weekend": (weekday >= 5).cast("int"),
        }
    )


def feat_snap(df: DataFrame, states: Sequence[str] = SNAP_STATES) -> DataFrame:
    """The snap flag of the row's own state (case-insensitive), 0 for other states."""
    if "state_id" not in df.columns:
        return df
    state = F.upper(F.col("state_id").cast("string"))
    flag: Column = F.lit(0)
    for s in states:
        if f"snap_{s}" in df.columns:
            flag = F.when(state == s.upper(), F.col(f"snap_{s}").cast("int")).otherwise(flag)
    return df.withColumn("snap", flag)


def feat_event(df: DataFrame) -> DataFrame:
    """1 on a day with a named event."""
    if "event_name_1" not in df.columns:
        return df
    return df.withColumn("is_event", (F.col("event_name_1") != "none").cast("int"))


def feat_price(df: DataFrame) -> DataFrame:
    """Price over its series mean, and the change against the previous row (0 if unknown)."""
    if "sell_price" not in df.columns:
        return df
    price = F.col("sell_price")
    before = F.lag(price).over(_ordered())
    return df.withColumns(
        {
            "price_norm": ratio(price, F.avg(price).over(_series())),
            "price_change_pct": F.coalesce(ratio(price - before, before), F.lit(0.0)),
        }
    )


def mean_encodings(df: DataFrame, as_of: Column | None = None) -> dict[str, DataFrame]:
    """The weekday mean tables, one per key set, all cut from a single grouped pass."""
    present = {n: k for n, k in ENCODING_KEYS.items() if set(k) <= set(df.columns)}
    if not present:
        return {}
    if "dayofweek" not in df.columns:
        df = df.withColumn("dayofweek", F.weekday("ds"))
    if as_of is not None:
        df = df.where(F.col("ds") <= as_of)
    used = list(dict.fromkeys(c for k in present.values() for c in k))
    sets = [[F.col(c) for c in (*k, "dayofweek")] for k in present.values()]
    table = settle(
        df.groupingSets(sets, *[F.col(c) for c in (*used, "dayofweek")])
        .agg(F.avg("y").alias("_mean"), *[F.grouping(c).alias(f"_g_{c}") for c in used])
    )
    out = {}
    for name, key in present.items():
        cond = F.lit(True)
        for c in used:
            cond = cond & (F.col(f"_g_{c}") == (0 if c in key else 1))
        out[name] = table.where(cond).select(*key, "dayofweek", F.col("_mean").alias(name))
    return out


def feat_mean_encoding(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Mean of y per (category | department | store | state | store x category, weekday).

    ``as_of`` restricts the means to rows up to a cutoff; without it every row counts, the
    holdout included.
    """
    if "y" not in df.columns:
        return df
    if "dayofweek" not in df.columns:
        df = feat_date(df)
    for name, table in mean_encodings(df, as_of).items():
        if name not in df.columns:
            df = df.join(table, [*ENCODING_KEYS[name], "dayofweek"], "left")
    return df


def event_distances(days: DataFrame) -> DataFrame:
    """Per day the distance to the strictly next and strictly previous event day.

    ``days`` is calendar-sized (ds, is_event), so one ordered window over it is fine.
    """
    event_day = F.when(F.col("is_event") == 1, F.col("ds"))
    order = W.partitionBy(F.lit(0)).orderBy("ds")
    nxt = F.first(event_day, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    prev = F.last(event_day, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    return days.select(
        "ds",
        F.coalesce(F.datediff(nxt, "ds"), F.lit(NO_EVENT)).alias("days_to_next_event"),
        F.coalesce(F.datediff("ds", prev), F.lit(NO_EVENT)).alias("days_since_last_event"),
    )


def feat_event_distance(df: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """week_of_month and the two event distances (999 where there is no such event).

    ``days`` may hand over the calendar; otherwise the days are taken from the panel.
    """
    df = df.withColumn("week_of_month", (F.floor((F.dayofmonth("ds") - 1) / 7) + 1).cast("int"))
    if "is_event" not in df.columns:
        df = feat_event(df)
    if "is_event" not in df.columns:
        return df
    if days is None:
        days = df.groupBy("ds").agg(F.max("is_event").alias("is_event"))
    elif "is_event" not in days.columns:
        days = feat_event(days)
    return df.join(F.broadcast(event_distances(days)), "ds", "left")


def price_rank() -> Column:
    """Average rank of the price among those of the same store and day; null without a price."""
    priced = F.col("sell_price").isNotNull()
    lowest = F.rank().over(W.partitionBy("store_id", "ds", priced).orderBy("sell_price"))
    ties = F.count("*").over(W.partitionBy("store_id", "ds", priced, "sell_price"))
    return F.when(priced, lowest + (ties - 1) / 2)


def feat_price_stats(df: DataFrame) -> DataFrame:
    """Series price mean, min and max, and the price rank within (store, day)."""
    if "sell_price" not in df.columns:
        return df
    df = df.withColumns(
        {
            "price_mean": F.avg("sell_price").over(_series()),
            "price_min": F.min("sell_price").over(_series()),
            "price_max": F.max("sell_price").over(_series()),
        }
    )
    if "store_id" in df.columns:
        df = df.withColumn("price_rank_in_store", price_rank())
    return df


def feat_release(df: DataFrame) -> DataFrame:
    """Days since the first positive day, -1 for a series that never sold."""
    first = F.min(F.when(F.col("y") > 0, F.col("ds"))).over(_series())
    return df.withColumn("days_since_release", F.coalesce(F.datediff("ds", first), F.lit(-1)))


def build_features(
    df: DataFrame, *, states: Sequence[str] = SNAP_STATES, as_of: Column | None = None, days: DataFrame | None = None
) -> DataFrame:
    """All features. The per-series windows come first so that they share one exchange."""
    return (
        df.transform(feat_date)
        .transform(feat_snap, states)
        .transform(feat_event)
        .transform(feat_price)
        .transform(feat_release)
        .transform(feat_mean_encoding, as_of)
        .transform(feat_event_distance, days)
        .transform(feat_price_stats)
    )


def feat_minimal(df: DataFrame, *, states: Sequence[str] = SNAP_STATES) -> DataFrame:
    """Date, snap, event and price features only."""
    return df.transform(feat_date).transform(feat_snap, states).transform(feat_event).transform(feat_price)


def feat_lags(df: DataFrame, lags: Sequence[int] = (7, 14, 28), value: str = "y") -> DataFrame:
    return df.withColumns({f"lag{k}": F.lag(value, k).over(_ordered()) for k in lags})


def feat_rolling_lagged(df: DataFrame, windows: Sequence[int] = (7, 28), value: str = "y") -> DataFrame:
    """Rolling means that end on the previous row; null until the window is full."""
    out = {}
    for w in windows:
        frame = _ordered().rowsBetween(-w, -1)
        out[f"rolling_mean_lag1_window_size{w}"] = F.when(F.count(value).over(frame) == w, F.avg(value).over(frame))
    return df.withColumns(out)


def feat_difference(df: DataFrame, k: int = 1, value: str = "y", out: str = "y_diff") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, k).over(_ordered()))


def undo_difference(forecast: DataFrame, last: DataFrame, value: str) -> DataFrame:
    """Inverse of first differencing: last level of the series plus the running sum.

    ``last`` has (unique_id, level).
    """
    running = F.sum(value).over(_ordered().rowsBetween(W.unboundedPreceding, 0))
    return forecast.join(last, "unique_id").withColumn(value, F.col("level") + running).drop("level")


def feat_context_window(df: DataFrame, length: int, value: str = "y") -> DataFrame:
    """The last ``length`` values of each series as an array, left-padded with zeros."""
    newest_first = W.partitionBy("unique_id").orderBy(F.desc("ds"))
    kept = df.withColumn("_rn", F.row_number().over(newest_first)).where(F.col("_rn") <= length)
    values = F.transform(
        F.sort_array(F.collect_list(F.struct("ds", F.col(value).cast("double").alias("v")))), lambda s: s["v"]
    )
    tail = kept.groupBy("unique_id").agg(values.alias("_tail"))
    pad = F.array_repeat(F.lit(0.0), F.lit(length) - F.size("_tail"))
    return tail.select("unique_id", F.concat(pad, "_tail").alias("context"))
