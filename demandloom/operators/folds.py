"""Rolling-origin folds and the exact baseline forecasters evaluated over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from demandloom.operators.reshape import latest

def _ordered() -> WindowSpec:
    return W.partitionBy("unique_id").orderBy("ds")


def cutoffs(panel: DataFrame, h: int, n_windows: int, step: int | None = None, end: Column | None = None) -> list[Column]:
    """The cutoff dates, oldest first: ``end - h - (n - 1 - w) * step``.

    ``end`` may be given when the last day is known more cheaply than from the panel.
    """
    end = latest(panel) if end is None else end
    step = step or h
    return [F.date_sub(end, h + (n_windows - 1 - w) * step) for w in range(n_windows)]


def fold_table(panel: DataFrame, h: int, n_windows: int, step: int | None = None, end: Column | None = None) -> DataFrame:
    """One row per fold with its cutoff and test range."""
    points = F.array(*cutoffs(panel, h, n_windows, step, end))
    one = panel.sparkSession.range(1)
    return one.select(F.posexplode(points).alias("fold", "cutoff")).select(
        "fold", "cutoff", F.date_add("cutoff", 1).alias("test_start"), F.date_add("cutoff", h).alias("test_end")
    )


def fold_train(panel: DataFrame, points: list[Column]) -> DataFrame:
    """Each row once per fold that may train on it."""
    return panel.withColumn("cutoff", F.explode(F.array(*points))).where(F.col("ds") <= F.col("cutoff"))


def fold_test(panel: DataFrame, points: list[Column], h: int) -> DataFrame:
    """Test rows ``(cutoff, cutoff + h]`` of every fold."""
    return (
        panel.where(F.col("ds") > points[0])
        .withColumn("cutoff", F.explode(F.array(*points)))
        .where((F.col("ds") > F.col("cutoff")) & (F.col("ds") <= F.date_add("cutoff", h)))
    )


def _history_state(season: int) -> dict[str, Column]:
    """Per row: the last ``season`` values, the mean so far and the next day of the series."""
    return {
        "_tail": F.collect_list("y").over(_ordered().rowsBetween(-(season - 1), 0)),
        "_mean": F.avg("y").over(_ordered().rowsBetween(W.unboundedPreceding, 0)),
        "_next": F.lead("ds").over(_ordered()),
    }


def _closes(point: Column) -> Column:
    """True on the last row of a series that is not after the point."""
    return (F.col("ds") <= point) & (F.col("_next").isNull() | (F.col("_next") > point))


def _baseline_values(state: Column, step: Column, season: int) -> tuple[Column, Column]:
    tail = state["tail"]
    seasonal = F.when(F.size(tail) >= season, F.get(tail, F.pmod(step - 1, F.lit(season)))).otherwise(state["mean"])
    return F.element_at(tail, -1), seasonal


def baseline_cv(
    panel: DataFrame, h: int, n_windows: int, step: int | None = None, *, season: int = 7, end: Column | None = None
) -> DataFrame:
    """Backtest of Naive and SeasonalNaive: ``unique_id, ds, cutoff, y, Naive, SeasonalNaive``.

    One window pass per series carries the state at each cutoff to the test rows; there is no
    join and no copy of the panel per fold. A series without a row up to a cutoff has no
    forecast in that fold.
    """
    points = cutoffs(panel, h, n_windows, step, end)
    whole = W.partitionBy("unique_id")
    rows = panel.select("unique_id", "ds", F.col("y").cast("double").alias("y")).withColumns(_history_state(season))
    state = F.struct(F.col("_tail").alias("tail"), F.col("_mean").alias("mean"))
    rows = rows.withColumns({f"_s{i}": F.first(F.when(_closes(p), state), ignorenulls=True).over(whole) for i, p in enumerate(points)})
    folds = F.array(*[F.struct(p.alias("cutoff"), F.col(f"_s{i}").alias("state")) for i, p in enumerate(points)])
    tested = (
        rows.where(F.col("ds") > points[0])
        .select("unique_id", "ds", "y", F.inline(folds))
        .where((F.col("ds") > F.col("cutoff")) & (F.col("ds") <= F.date_add("cutoff", h)) & F.col("state").isNotNull())
    )
    naive, seasonal = _baseline_values(F.col("state"), F.datediff("ds", "cutoff"), season)
    return tested.select("unique_id", "ds", "cutoff", "y", naive.alias("Naive"), seasonal.alias("SeasonalNaive"))


def baseline_forecast(panel: DataFrame, h: int, *, season: int = 7, end: Column | None = None) -> DataFrame:
    """Naive and SeasonalNaive for the ``h`` days after the panel's last day."""
    point = latest(panel) if end is None else end
    rows = panel.select("unique_id", "ds", F.col("y").cast("double").alias("y")).withColumns(_history_state(season))
    last = rows.where(_closes(point)).select(
        "unique_id",
        F.struct(F.col("_tail").alias("tail"), F.col("_mean").alias("mean")).alias("state"),
        F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"),
    )
    naive, seasonal = _baseline_values(F.col("state"), F.col("step"), season)
    return last.select(
        "unique_id", F.date_add(point, F.col("step")).alias("ds"), naive.alias("Naive"), seasonal.alias("SeasonalNaive")
    )


def ensemble(cv: DataFrame, columns: list[str], weights: list[float] | None = None, out: str = "ensemble") -> DataFrame:
    """Weighted mean of forecast columns (equal by default); weights are normalised."""
    if weights is None:
        weights = [1.0 / len(columns)] * len(columns)
    if len(weights) != len(columns):
        raise ValueError(f"{len(weights)} weights for {len(columns)} forecast columns")
    total = sum(weights)
    if total == 0:
        raise ValueError("weights sum to zero")
    mean = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        mean = mean + F.col(f"`{c}`") * (w / total)
    return cv.withColumn(out, mean)
