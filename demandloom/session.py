"""Session defaults and the places where lineage is cut on purpose."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "demandloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC dates, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and hand-off tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a local
    test session) a folder of our own is made.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        current = tempfile.mkdtemp(prefix="demandloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Like ``settle``, as a compressed table by column: for rows of repeated names or long arrays. Keeps no partitions."""
    path = fresh_path(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes the rows, survives executor loss, cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
