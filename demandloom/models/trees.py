"""Boosted forests over the whole panel: fitted by Spark ML, applied as arrays.

Boosting adds a small forest per round (its trees are grown side by side, so a round costs as many jobs as its trees are
deep). Each round is a Newton step of the objective: trees regress gradient over curvature, weighted by curvature.
The splits are written as a table (``tree, node, feature, value, left, right, leaf``) and the recursion over the horizon applies
them in batches of series, without a job per step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.models.panel_models import YEAR_ORIGIN, recurse_batches, step_features
from demandloom.models.segmented import DRIVERS, FEATURES, MEANS, fold_states, segment_frame
from demandloom.models.series import as_dates
from demandloom.operators.folds import fold_test
from demandloom.operators.reshape import latest
from demandloom.session import fresh_path, settle

ROUNDS, TREES, DEPTH, STEP = 8, 25, 6, 0.4
TRAIN_DAYS = 400
POWER = 1.1  # of the Tweedie variance
NODE_SCHEMA = "tree int, node int, feature int, value double, left int, right int, leaf double"
_FLOOR, _CAP = -20.0, 20.0


@dataclass
class Forest:
    """Flat trees: inner nodes send ``x[feature] <= value`` to ``left``; ``leaf`` is what a leaf adds to the log mean."""

    features: tuple[str, ...]
    start: float
    roots: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    depth: int
    coefficients: tuple[float, ...] = ()  # marks a score without coefficients per row

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log mean of rows of features."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                here = self.feature[at]
                down = np.where(x[rows, np.maximum(here, 0)] <= self.value[at], self.left[at], self.right[at])
                at = np.where(here >= 0, down, at)
            total += self.leaf[at]
        return total

    def score(self, values: dict[str, np.ndarray], beta: np.ndarray | None) -> np.ndarray:
        x = np.column_stack([np.asarray(values[f], dtype=float) for f in self.features])
        return np.exp(np.clip(self.raw(x), _FLOOR, _CAP))


def written_splits(model: RandomForestRegressionModel, step: float, first_tree: int) -> list[tuple]:
    """The nodes of a fitted forest; a tree counts with its share of the forest and the step of its round."""
    rows, share = [], step / len(model.trees)
    for t, tree in enumerate(model.trees):
        stack, count = [(tree._java_obj.rootNode(), 0)], 1
        while stack:
            node, k = stack.pop()
            if node.subtreeDepth() == 0:
                rows.append((first_tree + t, k, -1, 0.0, -1, -1, float(node.prediction()) * share))
                continue
            split = node.split()
            rows.append((first_tree + t, k, int(split.featureIndex()), float(split.threshold()), count, count + 1, 0.0))
            stack += [(node.leftChild(), count), (node.rightChild(), count + 1)]
            count += 2
    return rows


def assemble(nodes: DataFrame, features: Sequence[str], start: float) -> Forest:
    """The table of splits as arrays (trees x 2^depth rows, whatever the panel)."""
    pdf = nodes.toPandas().sort_values(["tree", "node"])
    sizes = pdf.groupby("tree").size()
    base = np.repeat(np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]]), sizes.to_numpy())
    move = lambda c: np.where(pdf[c].to_numpy() >= 0, pdf[c].to_numpy() + base, -1)
    roots = np.flatnonzero(pdf["node"].to_numpy() == 0)
    depth = int(np.ceil(np.log2(max(2, sizes.max() + 1)))) if len(sizes) else 0
    left, right, feature = move("left"), move("right"), pdf["feature"].to_numpy()
    level, at = 0, roots
    while len(at):  # true depth
        inner = at[feature[at] >= 0]
        at = np.concatenate([left[inner], right[inner]])
        level += bool(len(at))
    return Forest(tuple(features), start, roots, feature, pdf["value"].to_numpy(), left, right, pdf["leaf"].to_numpy(), max(level, min(depth, 1)))


def fit_forest(
    train: DataFrame, features: Sequence[str] = FEATURES, *, rounds: int = ROUNDS, trees: int = TREES, depth: int = DEPTH, step: float = STEP, power: float = POWER, seed: int = 42
) -> tuple[DataFrame, float]:
    """Table of splits and the start value (log of the mean) of a Tweedie forest on log scale.

    The training rows and their current log mean are checkpointed once per round.
    """
    spark = train.sparkSession
    x = [F.coalesce((F.col(f) - YEAR_ORIGIN if f == "year" else F.col(f)).cast("double"), F.lit(0.0)).alias(f) for f in features]
    rows = VectorAssembler(inputCols=list(features), outputCol="x").transform(train.select(F.col("y").cast("double").alias("y"), *x)).select("y", "x")
    mean = rows.agg(F.avg("y")).first()[0] or 0.0
    start = float(np.log(max(mean, 1e-6)))
    state, splits = settle(rows.withColumn("f", F.lit(start))), []
    for r in range(rounds):
        near, far = F.exp((1 - power) * F.col("f")), F.exp((2 - power) * F.col("f"))
        slope, curve = F.col("y") * near - far, (power - 1) * F.col("y") * near + (2 - power) * far
        todo = state.withColumn("w", F.greatest(curve, F.lit(1e-9))).withColumn("z", slope / F.col("w"))
        grower = RandomForestRegressor(
            featuresCol="x", labelCol="z", weightCol="w", predictionCol="g", numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.8,
            featureSubsetStrategy="onethird", minInstancesPerNode=20, seed=seed + r, cacheNodeIds=False,
        )
        model = grower.fit(todo.select("x", "z", "w"))
        splits += written_splits(model, step, r * trees)
        if r + 1 < rounds:
            state = settle(model.transform(state).select("y", "x", F.greatest(F.lit(_FLOOR), F.least(F.lit(_CAP), F.col("f") + step * F.col("g"))).alias("f")))
    path = fresh_path(spark, "splits")
    spark.createDataFrame(splits, NODE_SCHEMA).write.parquet(path)
    return spark.read.schema(NODE_SCHEMA).parquet(path), start


def raw_by_joins(rows: DataFrame, nodes: DataFrame, features: Sequence[str], start: float, depth: int) -> DataFrame:
    """``rows`` (with a unique ``row``) and their log mean ``raw`` by walking the table of splits with joins."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    roots = nodes.where("node = 0").select("tree")
    at = rows.select("row", x.alias("x")).join(F.broadcast(roots)).withColumn("node", F.lit(0))  # rows x trees
    tests = F.broadcast(nodes)
    for _ in range(depth):
        met = at.join(tests, ["tree", "node"])
        down = F.when(F.element_at("x", F.col("feature") + 1) <= F.col("value"), F.col("left")).otherwise(F.col("right"))
        at = met.select("row", "x", "tree", F.when(F.col("feature") >= 0, down).otherwise(F.col("node")).alias("node"))
    sums = at.join(tests, ["tree", "node"]).groupBy("row").agg((F.sum("leaf") + start).alias("raw"))
    return rows.join(sums, "row")


def recent_rows(panel: DataFrame, end: Column, train_days: int = TRAIN_DAYS) -> DataFrame:
    """The last ``train_days`` days up to ``end`` and the days their lags need, kept once for training and forecast."""
    return settle(panel.where((F.col("ds") <= end) & (F.col("ds") > F.date_sub(end, train_days + 28))))


def trained(recent: DataFrame, calendar: DataFrame, states: Sequence[str], end: Column, **options) -> tuple[DataFrame, float]:
    """Splits and start value of a forest on ``recent_rows``."""
    return fit_forest(segment_frame(recent, calendar, states, end).select("y", *FEATURES), **options)


def forecast_states(recent: DataFrame, calendar: DataFrame, h: int, *, states: Sequence[str], end: Column) -> DataFrame:
    return settle(fold_states(recent, calendar, states, as_dates(recent, [end]), h, end, ()))


def forecast(state: DataFrame, h: int, nodes: DataFrame, start: float) -> DataFrame:
    """``unique_id, ds, Trees`` of a written forest from ``forecast_states``: all steps of the horizon in one job."""
    return recurse_batches(state, h, assemble(nodes, FEATURES, start), "Trees", (*DRIVERS, *MEANS))


def first_step_by_joins(state: DataFrame, nodes: DataFrame, start: float) -> DataFrame:
    """``unique_id, ds, Trees`` of the first day ahead, recomputed from the written splits in SQL."""
    rows = step_features(state, 1, (*DRIVERS, *MEANS)).withColumn("year", F.col("year") - YEAR_ORIGIN).withColumn("row", F.col("unique_id"))
    raw = F.greatest(F.lit(_FLOOR), F.least(F.lit(_CAP), F.col("raw")))
    walked = raw_by_joins(rows, nodes, FEATURES, start, assemble(nodes, FEATURES, start).depth)
    return walked.select("unique_id", F.date_add("cutoff", 1).alias("ds"), F.exp(raw).alias("Trees"))


def fc_global_tree(
    panel: DataFrame, calendar: DataFrame, h: int, *, states: Sequence[str] = (), end: Column | None = None, train_days: int = TRAIN_DAYS, **options
) -> DataFrame:
    """``unique_id, ds, Trees``: lags, dates, drivers and statics of the last ``train_days`` days."""
    point = latest(panel) if end is None else end
    recent = recent_rows(panel, point, train_days)
    nodes, start = trained(recent, calendar, states, point, **options)
    return forecast(forecast_states(recent, calendar, h, states=states, end=point), h, nodes, start)


def cv_global_tree(panel: DataFrame, calendar: DataFrame, h: int, points: Sequence[Column], *, states: Sequence[str] = (), **options) -> DataFrame:
    """Backtest ``unique_id, ds, cutoff, y, Trees``; a fold trains on the rows up to its cutoff."""
    out = None
    for point in points:
        part = fc_global_tree(panel.where(F.col("ds") <= point), calendar, h, states=states, end=point, **options)
        truth = fold_test(panel, [point], h).select("unique_id", "ds", "cutoff", F.col("y").cast("double").alias("y"))
        part = truth.join(part, ["unique_id", "ds"])
        out = part if out is None else out.unionByName(part)
    return out
