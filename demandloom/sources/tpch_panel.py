"""Demand panels derived from the order-line star schema.

A line item becomes demand of an item in a store: the store is the supplier's nation, the
state its region, the item a group of brands of one part type. The result is a dense daily
panel that starts at each series' first sale, i.e. zero days are filled in and leading zeros
are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandloom.functions.expr import STATICS
from demandloom.operators.reshape import densify_panel, latest, weekly_price

EPOCH = "1995-01-02"  # a Monday, the first ship date
CATEGORY_TYPES = ("LARGE", "MEDIUM", "SMALL")


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; its schema is inferred once, which saves a footer job per later read."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def week_index(ds: Column) -> Column:
    return F.floor(F.datediff(ds, F.lit(EPOCH).cast("date")) / 7).cast("int")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with product attributes and the supplier's nation key.

    Part and supplier are joined straight from their scans, so the planner sees their real
    size: broadcast while small, a shuffled join once they are not.
    """
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    products = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_type").alias("dept_id"),
        F.when(F.col("p_type").isin(*CATEGORY_TYPES), "SIZE").otherwise("TIER").alias("cat_id"),
        F.ceil(brand / 5).cast("int").alias("brand_group"),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            F.col("l_shipdate").cast("date").alias("ds"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        )
        .join(products, F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )


def _places(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Replace the nation key by store and state names (25 nations, 5 regions: broadcast)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("store_id"))
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("state_id"))
    named = df.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return named.drop("s_nationkey", "n_nationkey", "n_regionkey", "r_regionkey")


def sales_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (series, day) with a sale: units and value in cents. Sparse.

    Aggregated on the keys first; names are attached to the far fewer aggregated rows.
    """
    sums = (
        _lines(spark, sf_dir)
        .groupBy("dept_id", "cat_id", "brand_group", "s_nationkey", "ds")
        .agg(F.sum("l_quantity").alias("y"), F.sum("cents").alias("cents"))
    )
    named = _places(spark, sf_dir, sums).withColumn("item_id", F.concat_ws("-", "dept_id", F.col("brand_group").cast("string")))
    return named.withColumn("unique_id", F.concat_ws("_", "item_id", "store_id")).drop("brand_group")


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates only: the cheapest frame that knows the panel's time span."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("ds"))


def last_ship_day(spark: SparkSession, sf_dir: str) -> Column:
    return latest(ship_days(spark, sf_dir))


def priced_panel(facts: DataFrame, end: Column) -> DataFrame:
    """Dense panel of the facts over the whole history, with the weekly price."""
    dense = densify_panel(facts, statics=list(STATICS), fill=["y", "cents"], until=end)
    return weekly_price(dense.withColumn("wk", week_index(F.col("ds")))).drop("cents")


def small_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per (part type, region, day): every line item, few series."""
    return (
        _places(spark, sf_dir, _lines(spark, sf_dir))
        .groupBy("dept_id", "cat_id", "state_id", "ds")
        .agg(F.sum("l_quantity").alias("y"), F.sum("cents").alias("cents"))
        .withColumns(
            {"unique_id": F.concat_ws("_", "dept_id", "state_id"), "item_id": F.col("dept_id"), "store_id": F.col("state_id")}
        )
    )


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second panel: number of events per type and day."""
    facts = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("unique_id"), F.col("ts").cast("date").alias("ds"))
        .agg(F.count("*").cast("double").alias("y"))
    )
    return densify_panel(facts, statics=[], fill=["y"])


def calendar(panel: DataFrame) -> DataFrame:
    """One row per day of the panel with a holiday name and snap flags for three regions."""
    month_day = F.date_format("ds", "MM-dd")
    day = F.dayofmonth("ds")
    span = panel.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi")).alias("ds")).select(
        "ds",
        F.when(month_day == "01-01", "NewYear")
        .when(month_day == "07-04", "Independence")
        .when(month_day == "12-25", "Christmas")
        .otherwise("none")
        .alias("event_name_1"),
        (day <= 10).cast("int").alias("snap_AFRICA"),
        ((day > 10) & (day <= 20)).cast("int").alias("snap_AMERICA"),
        (day > 20).cast("int").alias("snap_ASIA"),
    )
