"""A versioned store of trained models, and scoring of requests from it.

A version is a folder of tables: history tail, statics, coefficients, metadata. It is published by one more table below
``published``, written when all others are complete and never overwritten; the newest published version counts, so a reader sees
a whole version or the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.models.panel_models import BASE_FEATURES, TAIL, Scorer, fit_linear, forecast_state, recurse_batches, training_frame
from demandloom.operators.demand import request_rejects_by_id, validate_requests
from demandloom.operators.reshape import keep_series, latest
from demandloom.sources.sinks import sink_train_bundle

COEFFICIENTS = "place int, feature string, value double"
MIN_HISTORY = 55


@dataclass
class Stored:
    """A loaded version."""

    version: str
    history: DataFrame
    statics: DataFrame
    metadata: DataFrame
    scorer: Scorer


def train_linear(panel: DataFrame, end: Column | None = None, days: int = 400) -> Scorer:
    """The global linear model on the last ``days`` days."""
    point = latest(panel) if end is None else end
    recent = panel.where((F.col("ds") <= point) & (F.col("ds") > F.date_sub(point, days + TAIL)))
    return fit_linear(training_frame(recent), BASE_FEATURES)


def publish(panel: DataFrame, scorer: Scorer, store: str, version: str) -> str:
    """Write a version completely, then name it the newest."""
    spark, folder = panel.sparkSession, f"{store}/versions"
    sink_train_bundle(panel, folder, version)
    rows = [(0, "intercept", float(scorer.intercept)), *[(k, f, float(c)) for k, (f, c) in enumerate(zip(scorer.features, scorer.coefficients), 1)]]
    spark.createDataFrame(rows, COEFFICIENTS).coalesce(1).write.parquet(f"{folder}/{version}/coefficients")
    before = _published(spark, store)
    number = 0 if before is None else before.agg(F.max("number")).first()[0] + 1
    spark.createDataFrame([(number, version)], "number int, version string").coalesce(1).write.parquet(f"{store}/published/{number:08d}")
    return version


def _published(spark: SparkSession, store: str) -> DataFrame | None:
    """All published versions; a folder without Spark's mark of success isn't one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/published")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    done = [str(s.getPath()) for s in system.listStatus(path) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema("number int, version string").parquet(*done) if done else None


def load(spark: SparkSession, store: str) -> Stored:
    """The newest published version."""
    known = _published(spark, store)
    if known is None:
        raise ValueError(f"nothing is published in {store}")
    version = known.agg(F.max_by("version", "number")).first()[0]
    read = lambda name: spark.read.parquet(f"{store}/versions/{version}/{name}")
    rows = sorted(read("coefficients").collect(), key=lambda r: r["place"])
    scorer = Scorer(tuple(r["feature"] for r in rows[1:]), tuple(r["value"] for r in rows[1:]), rows[0]["value"])
    return Stored(version, read("history"), read("statics"), read("metadata"), scorer)


def score_ids(stored: Stored, requests: DataFrame, h: int) -> tuple[DataFrame, DataFrame]:
    """Forecasts ``unique_id, ds, y_hat`` of the requested series from stored history, and the ids that aren't known."""
    ids = requests.select("unique_id").distinct()
    state = keep_series(forecast_state(stored.history), ids)
    return recurse_batches(state, h, stored.scorer, "y_hat"), request_rejects_by_id(requests, stored.statics)


def score_histories(stored: Stored, history: DataFrame, h: int, min_rows: int = MIN_HISTORY) -> tuple[DataFrame, DataFrame]:
    """Forecasts from the caller's own history (statics attached), and the rejected ids with reasons.

    Every series starts from its own last day.
    """
    rejects = validate_requests(history, stored.statics, min_rows=min_rows)
    good = history.join(rejects.select("unique_id"), "unique_id", "left_anti")
    ends = good.groupBy("unique_id").agg(F.max("ds").alias("cutoff"))
    recent = good.join(ends, "unique_id").where(F.col("ds") > F.date_sub("cutoff", TAIL))
    values = F.transform(F.sort_array(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("v")))), lambda s: F.coalesce(s["v"], F.lit(0.0)))
    state = recent.groupBy("unique_id", "cutoff").agg(values.alias("hist"))
    state = state.withColumn("hist", F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.lit(TAIL) - F.size("hist"), F.lit(0))), F.slice("hist", -F.least(F.size("hist"), F.lit(TAIL)), TAIL)))
    out = recurse_batches(state, h, stored.scorer, "y_hat")
    return out.join(stored.statics, "unique_id"), rejects
