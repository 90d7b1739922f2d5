"""Raw retail tables (calendar, prices, wide sales) as typed DataFrames."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions.expr import need

EVENT_COLUMNS = ("event_name_1", "event_type_1", "event_name_2", "event_type_2")
CALENDAR_TYPES = {
    "date": "date",
    "wm_yr_wk": "int",
    **{c: "string" for c in EVENT_COLUMNS},
    "snap_CA": "tinyint",
    "snap_TX": "tinyint",
    "snap_WI": "tinyint",
}
PRICE_SCHEMA = "store_id string, item_id string, wm_yr_wk int, sell_price float"
SALES_IDS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Generic CSV scan with a header; without a schema every column is a string."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def load_calendar(spark: SparkSession, raw_dir: str) -> DataFrame:
    """Typed calendar with 'none' for missing events and the day label ``d_1, d_2, ...``.

    The label is the day's position. Files have no row order in Spark, so it is counted from
    the first date, which needs the dates to be without gaps; that is checked.
    """
    raw = read_csv(spark, f"{raw_dir}/calendar.csv")
    need(raw, "date", "wm_yr_wk")
    typed = raw.select(*[F.col(c).cast(t).alias(c) for c, t in CALENDAR_TYPES.items() if c in raw.columns])
    lo, hi, n = typed.agg(F.min("date"), F.max("date"), F.count("*")).first()
    if n and (hi - lo).days + 1 != n:
        raise ValueError(f"calendar has {n} rows for the span {lo}..{hi}")
    events = {c: "none" for c in EVENT_COLUMNS if c in typed.columns}
    label = F.concat(F.lit("d_"), (F.datediff("date", F.lit(lo)) + 1).cast("string"))
    return typed.na.fill(events).withColumn("d", label)


def load_prices(spark: SparkSession, raw_dir: str) -> DataFrame:
    """Weekly prices: ``store_id, item_id, wm_yr_wk, sell_price``."""
    return read_csv(spark, f"{raw_dir}/sell_prices.csv", PRICE_SCHEMA)


def load_sales_wide(spark: SparkSession, raw_dir: str, n_days: int | None = None) -> DataFrame:
    """Wide unit sales: id columns, ``unique_id`` and ``units``, the day columns as one array.

    The file has one column per day (about two thousand). As an array they stay one expression
    in every plan, where a column each would make the generated code explode. Reads the
    evaluation file, or the validation file where that is absent. Cells may be quoted. With
    ``n_days`` only the first days are kept.
    """
    try:
        lines = spark.read.text(f"{raw_dir}/sales_train_evaluation.csv")
    except AnalysisException:
        lines = spark.read.text(f"{raw_dir}/sales_train_validation.csv")
    is_header = F.col("value").rlike(f'^"?{SALES_IDS[0]}"?,')
    header = next(csv.reader([lines.where(is_header).first()[0].strip()]))
    days = header[len(SALES_IDS) :]
    if tuple(header[: len(SALES_IDS)]) != SALES_IDS or days != [f"d_{k + 1}" for k in range(len(days))]:
        raise ValueError("sales header has to be the id columns followed by d_1, d_2, ...")
    kept = len(days) if n_days is None else min(n_days, len(days))
    raw = F.regexp_extract_all("value", F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1))
    bare = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    cells = lines.where(~is_header & (F.trim("value") != "")).select(
        F.when(F.instr("value", '"') > 0, bare).otherwise(F.split("value", ",")).alias("_c")
    )
    return cells.select(
        *[F.element_at("_c", k + 1).alias(c) for k, c in enumerate(SALES_IDS)],
        F.concat_ws("_", F.element_at("_c", 2), F.element_at("_c", 5)).alias("unique_id"),
        F.transform(F.slice("_c", len(SALES_IDS) + 1, kept), lambda v: v.try_cast("float")).alias("units"),
    )
