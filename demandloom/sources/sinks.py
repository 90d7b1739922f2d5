"""Writers of tables the library hands on: metrics, forecasts, bundles, dashboard records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators.reshape import latest, static_attributes

CSV_TOO = ("headline", "fva_star", "fva_chain", "fva_per_fold")
HISTORY_DAYS = 120


def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def sink_metrics(tables: Mapping[str, DataFrame], out_dir: str) -> list[str]:
    """One parquet table per score axis; headline and value-added tables as CSV too."""
    written = []
    for name, df in tables.items():
        written.append(sink_parquet(df, f"{out_dir}/{name}"))
        if name in CSV_TOO:
            df.write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}_csv")
            written.append(f"{out_dir}/{name}_csv")
    return written


def sink_forecast(forecast: DataFrame, model: str, out_dir: str) -> str:
    """``forecast_<model>`` table. Fitted interval widths are stored with the same call."""
    return sink_parquet(forecast, f"{out_dir}/forecast_{model}")


def history_days(max_lag: int = 28, max_roll: int = 28, buffer: int = HISTORY_DAYS) -> int:
    return max(max_lag + max_roll, buffer)


def train_select_history(panel: DataFrame, days: int | None = None) -> DataFrame:
    """The trailing rows a stateful scorer needs: ``ds >= max(ds) - days``."""
    start = F.date_sub(latest(panel), days if days is not None else history_days())
    return panel.where(F.col("ds") >= start).select("unique_id", "ds", "y")


def sink_train_bundle(panel: DataFrame, out_dir: str, version: str, *, horizon: int = 28, lags: Sequence[int] = (7, 14, 28), windows: Sequence[int] = (7, 28), model=None) -> dict[str, str]:
    """History tail, statics, one metadata row and the pointer to the newest version.

    ``model`` may be a fitted Spark ML model, stored next to the tables.
    """
    base = f"{out_dir}/{version}"
    max_lag, max_roll = max(lags, default=0), max(windows, default=0)
    statics = static_attributes(panel)
    days = history_days(max_lag, max_roll)
    sizes = panel.groupBy("unique_id").agg(F.count("*").alias("n"), F.max("ds").alias("hi"))
    metadata = sizes.agg(
        F.lit(version).alias("version"),
        F.max("hi").alias("training_cutoff"),
        F.lit(horizon).alias("horizon_default"),
        F.array(*[F.lit(x) for x in lags]).alias("lags"),
        F.array(*[F.lit(x) for x in windows]).alias("rolling_windows"),
        F.count("*").alias("n_series"),
        F.sum("n").alias("n_rows"),
        F.lit(max(max_lag + max_roll - 1, max_lag)).alias("min_history_required"),
        F.array(*[F.lit(c) for c in statics.columns if c != "unique_id"]).alias("static_features"),
    )
    paths = {
        "history": sink_parquet(train_select_history(panel, days), f"{base}/history"),
        "statics": sink_parquet(statics, f"{base}/statics"),
        "metadata": sink_parquet(metadata, f"{base}/metadata"),
    }
    if model is not None:
        model.write().overwrite().save(f"{base}/model")
        paths["model"] = f"{base}/model"
    pointer = panel.sparkSession.createDataFrame([(version, base)], "version string, path string")
    paths["latest"] = sink_parquet(pointer, f"{out_dir}/latest")
    return paths


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, as JSON has neither."""
    out = {}
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            c = F.col(f"`{f.name}`")
            out[f.name] = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    return df.withColumns(out) if out else df


def sink_dashboard_json(tables: Mapping[str, DataFrame], out_dir: str) -> list[str]:
    """One JSON-lines table per dashboard section."""
    written = []
    for name, df in tables.items():
        finite_or_null(df).write.mode("overwrite").json(f"{out_dir}/{name}")
        written.append(f"{out_dir}/{name}")
    return written
