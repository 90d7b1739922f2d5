"""Loading several backtest tables into one wide frame."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.functions.expr import KEYS, forecast_columns


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def discover(spark: SparkSession, directory: str, prefix: str = "cv_") -> dict[str, str]:
    """Backtest tables below a directory by name, through the cluster's file system."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{directory.rstrip('/')}/{prefix}*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = sorted(status.getPath().toString() for status in found)
    return {os.path.basename(p).removeprefix(prefix).removesuffix(".parquet"): p for p in paths}


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({"ds": F.col("ds").cast("date"), "cutoff": F.col("cutoff").cast("date")})


def load_cv_inner(spark: SparkSession, paths: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Inner join on (series, day, cutoff) with every forecast column prefixed by its table.

    The truth comes from the first table. Raises when the tables share no key.
    """
    if not paths:
        raise ValueError("no backtest table given")
    merged: DataFrame | None = None
    names: list[str] = []
    for name, path in paths.items():
        part = _typed(read_table(spark, path))
        renamed = {c: f"{name}_{c}" for c in forecast_columns(part)}
        names += renamed.values()
        part = part.select(*KEYS, *([] if merged is not None else ["y"]), *[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
        merged = part if merged is None else merged.join(part, list(KEYS), "inner")
    if merged.isEmpty():
        raise ValueError("the backtest tables share no (unique_id, ds, cutoff) key")
    return merged, names


def load_cv_dashboard(spark: SparkSession, paths: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """As :func:`load_cv_inner`, with a check of the key columns; tables without a forecast are skipped."""
    usable = {}
    for name, path in paths.items():
        have = read_table(spark, path)
        lacking = sorted({*KEYS, "y"} - set(have.columns))
        if lacking:
            raise ValueError(f"{name} lacks {lacking}")
        if forecast_columns(have):
            usable[name] = path
    if not usable:
        raise ValueError("no table has a forecast column")
    return load_cv_inner(spark, usable)


def load_cv_outer(spark: SparkSession, paths: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Full outer join; only forecast columns that occur twice are renamed ``table:column``.

    The truth is taken from whichever table has the row.
    """
    frames = {name: _typed(read_table(spark, path)) for name, path in paths.items()}
    seen = Counter(c for df in frames.values() for c in forecast_columns(df))
    merged: DataFrame | None = None
    names: list[str] = []
    for name, df in frames.items():
        renamed = {c: f"{name}:{c}" if seen[c] > 1 else c for c in forecast_columns(df)}
        names += renamed.values()
        part = df.select(*KEYS, F.col("y").alias("_y"), *[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
        if merged is None:
            merged = part.withColumnRenamed("_y", "y")
            continue
        joined = merged.join(part, list(KEYS), "full")
        merged = joined.withColumn("y", F.coalesce("y", "_y")).drop("_y")
    return merged, names
