"""Reshaping, filtering and sampling of long panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.expr import KEYS, STATICS, draw_number, forecast_columns, ratio


def latest(df: DataFrame, column: str = "ds") -> Column:
    """The largest value of a column as a literal.

    One aggregate job brings a single value to the driver; as a literal it is pushed into
    scans and folded by the optimizer, which a subquery would not be.
    """
    return F.lit(df.agg(F.max(column)).first()[0]).cast(df.schema[column].dataType)


def densify_panel(
    facts: DataFrame,
    *,
    statics: Sequence[str] = (),
    fill: Sequence[str] = ("y",),
    until: Column | None = None,
) -> DataFrame:
    """Fill the missing days of every series with zeros, from its first row to the last day.

    Only the sparse rows are shuffled: each row is stretched up to the day before the next row
    of its series, so the filled panel appears already partitioned by series and no join with
    a grid is needed. The partition count is fixed, because the sparse rows would let adaptive
    execution merge partitions that become far larger once filled. Rows after ``until`` are dropped.
    """
    end = until if until is not None else latest(facts)
    facts = facts.where(F.col("ds") <= end)
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = facts.repartition(partitions, "unique_id")
    by_id = W.partitionBy("unique_id").orderBy("ds")
    # several rows of one day stay rows of that day; the last of them is stretched
    stop = F.greatest(F.col("ds"), F.coalesce(F.date_sub(F.lead("ds").over(by_id), 1), end))
    stretched = facts.select(
        "unique_id", *statics, *fill, F.col("ds").alias("_from"), stop.alias("_to")
    ).withColumn("ds", F.explode(F.sequence("_from", "_to")))
    first = F.col("ds") == F.col("_from")
    zero = lambda c: F.when(first, F.col(c)).otherwise(F.lit(0).cast(facts.schema[c].dataType))
    return stretched.select("unique_id", "ds", *statics, *[zero(c).alias(c) for c in fill])


def weekly_price(panel: DataFrame, *, value: str = "cents", week: str = "wk") -> DataFrame:
    """Average unit price of the series' week; null in a week without a sale."""
    by_week = W.partitionBy("unique_id", week)
    price = ratio(F.sum(value).over(by_week).cast("double") / 100.0, F.sum("y").over(by_week))
    return panel.withColumn("sell_price", price)


def unpivot_sales(sales: DataFrame, ids: Sequence[str], first_day: int = 1) -> DataFrame:
    """The ``units`` array (day ``first_day`` onwards) to rows ``ids, d, y`` through one generator."""
    label = F.concat(F.lit("d_"), (F.col("_i") + first_day).cast("string"))
    return sales.select(*ids, F.posexplode("units").alias("_i", "y")).select(*ids, label.alias("d"), "y")


def join_calendar(long: DataFrame, calendar: DataFrame, on: str = "d") -> DataFrame:
    """Attach the day attributes. A calendar has one row per day, so it is broadcast."""
    return long.join(F.broadcast(calendar), on, "left")


def join_prices(long: DataFrame, prices: DataFrame, on: Sequence[str] = ("store_id", "item_id", "wm_yr_wk")) -> DataFrame:
    """Attach prices; they grow with the panel, so the join strategy is left to the optimizer."""
    return long.join(prices, list(on), "left")


def drop_leading_zeros(panel: DataFrame) -> DataFrame:
    """Keep each series from its first positive day on; never-sold series vanish."""
    by_id = W.partitionBy("unique_id")
    first = F.min(F.when(F.col("y") > 0, F.col("ds"))).over(by_id)
    return panel.withColumn("_first", first).where(F.col("ds") >= F.col("_first")).drop("_first")


def trim_last_n_days(panel: DataFrame, n: int) -> DataFrame:
    """Rows with ``ds >= max(ds) - n``, i.e. n + 1 calendar days."""
    return panel.where(F.col("ds") >= F.date_sub(latest(panel), n))


def build_long(
    sales: DataFrame,
    calendar: DataFrame,
    prices: DataFrame,
    *,
    last_n_days: int | None = None,
    n_series: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Wide sales + calendar + prices to the long panel.

    Leading zeros are judged on the whole history: a series that only sold before the trailing
    window keeps its zero rows there.
    """
    if n_series:
        sales = subsample_series(sales, n_series, seed)
    ids = ["unique_id", *STATICS]
    first = F.array_position(F.transform("units", lambda v: F.coalesce(v > 0, F.lit(False))), True)
    sold = sales.withColumn("_first", first).where(F.col("_first") > 0)
    earliest = F.size("units") - last_n_days if last_n_days else F.lit(1)
    start = F.greatest(F.col("_first"), earliest, F.lit(1))
    # days before the start are cut from the array, so they are never generated
    kept = sold.withColumn("_start", start.cast("int")).withColumn("units", F.slice("units", F.col("_start"), F.size("units")))
    label = F.concat(F.lit("d_"), (F.col("_i") + F.col("_start")).cast("string"))
    long = kept.select(*ids, "_start", F.posexplode("units").alias("_i", "y")).select(*ids, label.alias("d"), "y")
    long = join_calendar(long, calendar)
    long = join_prices(long, prices).withColumnRenamed("date", "ds")
    return long.withColumn("y", F.col("y").cast("float"))


def subsample_series(panel: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Keep ``n`` series drawn by a seeded hash of the id."""
    ids = panel.select("unique_id").distinct()
    kept = ids.orderBy(draw_number(F.lit(seed), F.col("unique_id")), "unique_id").limit(n)
    return panel.join(kept, "unique_id", "left_semi")


def split_train_horizon(panel: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to ``max(ds) - horizon`` and the rows after."""
    cutoff = F.date_sub(latest(panel), horizon)
    return panel.where(F.col("ds") <= cutoff), panel.where(F.col("ds") > cutoff)


def tail_per_group(df: DataFrame, n: int, by: str = "unique_id", order: str = "ds") -> DataFrame:
    """Last ``n`` rows of each group."""
    return _edge_rows(df, n, by, F.col(order).desc())


def head_per_group(df: DataFrame, n: int, by: str = "unique_id", order: str = "ds") -> DataFrame:
    """First ``n`` rows of each group."""
    return _edge_rows(df, n, by, F.col(order).asc())


def _edge_rows(df: DataFrame, n: int, by: str, order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_rn") <= n).drop("_rn")


def pct_change(df: DataFrame, value: str, by: str = "unique_id", order: str = "ds", out: str = "pct_change") -> DataFrame:
    """Relative change against the previous row of the group."""
    before = F.lag(value).over(W.partitionBy(by).orderBy(order))
    return df.withColumn(out, ratio(F.col(value) - before, before))


_INT_RANGES = (("tinyint", 127), ("smallint", 32_767), ("int", 2_147_483_647))


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the smallest fitting type, from one min/max aggregate."""
    numeric = [f for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "double", "float")]
    ints = [f.name for f in numeric if f.dataType.typeName() not in ("double", "float")]
    casts = {f.name: "float" for f in numeric if f.dataType.typeName() in ("double", "float")}
    if ints:
        ranges = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in ints]).first()
        for c in ints:
            lo, hi = ranges[c]["lo"], ranges[c]["hi"]
            if lo is None:
                continue
            fits = [t for t, top in _INT_RANGES if -top - 1 <= lo and hi <= top]
            casts[c] = fits[0] if fits else "bigint"
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})


def static_attributes(panel: DataFrame) -> DataFrame:
    """One row per series with the attribute columns the panel has (from its first day)."""
    have = [c for c in STATICS if c in panel.columns]
    return panel.groupBy("unique_id").agg(*[F.min_by(c, "ds").alias(c) for c in have])


def fill_values(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Null defaults for the named columns that exist."""
    return df.na.fill({c: v for c, v in defaults.items() if c in df.columns})


def category_from_id(df: DataFrame, column: str = "item_id", out: str = "category") -> DataFrame:
    """First underscore-separated token of an id."""
    return df.withColumn(out, F.split_part(F.col(column), F.lit("_"), F.lit(1)))


def top_n_series(panel: DataFrame, n: int, measure: Column | None = None) -> DataFrame:
    """The ``n`` series with the largest total (units by default), largest first."""
    total = F.sum(measure if measure is not None else F.col("y")).alias("total")
    return panel.groupBy("unique_id").agg(total).orderBy(F.desc("total"), "unique_id").limit(n)


def keep_series(panel: DataFrame, ids: DataFrame) -> DataFrame:
    return panel.join(ids.select("unique_id"), "unique_id", "left_semi")


def dedupe_keep_latest(df: DataFrame) -> DataFrame:
    """Per (series, day) the row of the latest cutoff, picked by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in ("unique_id", "ds")]
    newest = F.max_by(F.struct(*rest), "cutoff").alias("_r")
    return df.groupBy("unique_id", "ds").agg(newest).select("unique_id", "ds", *[F.col(f"_r.{c}").alias(c) for c in rest])


def models_long(cv: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Wide backtest frame to one row per (key, model)."""
    models = list(models or forecast_columns(cv))
    keys = [c for c in (*KEYS, "y") if c in cv.columns]
    typed = cv.withColumns({m: F.col(f"`{m}`").cast("double") for m in models})
    return typed.unpivot(keys, [F.col(f"`{m}`") for m in models], "model", "y_hat")


def future_frame(panel: DataFrame, h: int, cutoff: Column | None = None) -> DataFrame:
    """The ``h`` days after the cutoff for every series (a generator, no cross join)."""
    start = cutoff if cutoff is not None else latest(panel)
    ids = panel.groupBy("unique_id").agg(F.max("ds").alias("_last"))
    return ids.select(
        "unique_id", F.explode(F.sequence(F.date_add(start, 1), F.date_add(start, h))).alias("ds")
    )


def union_forecasts(*frames: DataFrame) -> DataFrame:
    """Stack model or segment outputs by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# The first forecast day of the competition calendar and its horizon.
FIRST_FORECAST_DAY = 1942
SUBMISSION_HORIZON = 28


def submission_wide(
    preds: DataFrame, *, h: int = SUBMISSION_HORIZON, value_col: str | None = None, layout: str = "kaggle"
) -> DataFrame:
    """Long forecasts to one row per series and one column per day, in date order.

    Column names are ``F1..Fh`` or, with layout ``d_index``, the day labels of the holdout.
    """
    if value_col is None:
        candidates = [c for c in preds.columns if c not in ("unique_id", "ds")]
        if len(candidates) != 1:
            raise ValueError(f"cannot infer the value column from {candidates}")
        value_col = candidates[0]
    names = {
        "kaggle": [f"F{k + 1}" for k in range(h)],
        "d_index": [f"d_{FIRST_FORECAST_DAY + k}" for k in range(h)],
    }
    if layout not in names:
        raise ValueError(f"unknown layout {layout!r}, use one of {sorted(names)}")
    days = [r["ds"] for r in preds.select("ds").distinct().orderBy("ds").limit(h + 1).collect()]  # h + 1 dates at most
    if len(days) != h:
        raise ValueError(f"forecast covers {len(days)} dates, expected {h}")
    picked = [F.first(F.when(F.col("ds") == day, F.col(value_col)), ignorenulls=True).alias(n) for day, n in zip(days, names[layout], strict=True)]
    return preds.groupBy("unique_id").agg(*picked).orderBy("unique_id")


def encode_categoricals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """String columns to indices (most frequent first), unseen values kept as an extra index."""
    from pyspark.ml.feature import StringIndexer

    have = [c for c in columns if c in df.columns]
    indexer = StringIndexer(inputCols=have, outputCols=[f"{c}_idx" for c in have], handleInvalid="keep")
    return indexer.fit(df).transform(df)
