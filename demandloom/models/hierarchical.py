"""Hierarchical forecasting: roll up, forecast every node, reconcile, roll up again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.models.series import BatchModel, SeriesModel, as_dates, fold_base, one_by_one
from demandloom.models.smoothing import theta_batch
from demandloom.operators.folds import fold_test
from demandloom.operators.hierarchy import BOTTOM, PLACE_PRODUCT, hier_edges, roll_up
from demandloom.operators.reconcile import METHODS, NO_HISTORY, TRACE_METHODS, mintrace_gradient, recon_mintrace, reconcile_bottom, weighted
from demandloom.operators.reshape import latest
from demandloom.session import settle

THETA = partial(theta_batch, season=7)


def node_base(panel: DataFrame, h: int, points: Sequence[Column], model: BatchModel = THETA) -> DataFrame:
    """Base forecasts, fitted values and actuals of every node and fold (``fold_base``); a point is a fold's last known day.

    Only days with a sale are rolled up and shuffled; histories are filled where they are fitted.
    """
    sold = panel.where((F.col("y") != 0) & (F.col("ds") <= F.greatest(*points) if len(points) > 1 else F.col("ds") <= points[0]))
    # a task has all series of its days, so upper nodes are summed up before the shuffle
    nodes = roll_up(sold.select(*PLACE_PRODUCT, "ds", "y").repartition("ds"), ["y"], ["ds"])
    keyed = nodes.select(node_key("level_idx", "node").alias("node_id"), "ds", "y")
    return fold_base(keyed, model, h, as_dates(panel, points))


def node_key(level: str, node: str) -> Column:
    return F.concat_ws(":", F.col(level).cast("string"), node)


def keyed_edges(statics: DataFrame) -> DataFrame:
    """Edges of the summing matrix by node key; the items are the blocks of reconciliation."""
    edges = hier_edges(statics).join(statics.select(F.col("unique_id").alias("bottom_id"), F.col("item_id").alias("block")), "bottom_id")
    return edges.select("bottom_id", node_key("level_idx", "node").alias("node_id"), (F.col("level_idx") == BOTTOM).alias("is_bottom"), "block")


def _batch(model: SeriesModel | BatchModel | None, batched: bool) -> BatchModel:
    return THETA if model is None else model if batched else one_by_one(model)


def _long(wide: DataFrame, h: int, name: str) -> DataFrame:
    """``fold, unique_id, ds, <name>`` of ``fold, bottom_id, k1..kh``."""
    values = F.posexplode(F.array(*[f"k{j}" for j in range(1, h + 1)])).alias("_k", name)
    day = F.date_add(F.col("fold").cast("date"), F.col("_k") + 1).alias("ds")
    return wide.select("fold", F.col("bottom_id").alias("unique_id"), values).select("fold", "unique_id", day, name)


def with_ahead(base: DataFrame, methods: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The base of ``methods`` and its forecasts alone, settled. Histories are many times as large: those that one method reads once stay unwritten."""
    readers = [m for m in methods if m not in NO_HISTORY]
    if readers not in ([], ["MinT_shrink"]):
        base = settle(base)
    return base, settle(base.select("fold", "node_id", "y_hat"))


def hier_bottom(base: DataFrame, edges: DataFrame, h: int, methods: Sequence[str], ahead: DataFrame | None = None) -> DataFrame:
    """``fold, unique_id, ds, <method>...``: the bottom forecasts of all methods, of all folds together; ``ahead`` is the base without histories."""
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown method {unknown[0]!r}, use one of {sorted(METHODS)}")
    parts = [_long(reconcile_bottom(base if ahead is None or m not in NO_HISTORY else ahead, edges, h, m), h, m) for m in methods]
    return reduce(lambda a, b: a.join(b, ["fold", "unique_id", "ds"]), parts)


def hier_forecast(
    panel: DataFrame,
    statics: DataFrame,
    h: int,
    methods: Sequence[str] = ("BU", "MinT_OLS", "MinT_shrink"),
    *,
    model: SeriesModel | BatchModel | None = None,
    batched: bool = False,
    end: Column | None = None,
    bottom_only: bool = True,
) -> DataFrame:
    """Reconciled forecasts of the bottom series, ``unique_id, ds, <method>...``, or of all nodes.

    With ``bottom_only=False``: ``level_idx, level, unique_id, ds, base, <method>...``, where ``base`` is the node's own
    forecast and the methods are sums of their bottom forecasts, so every method is coherent.
    """
    end = latest(panel) if end is None else end
    base = settle(node_base(panel, h, [end], _batch(model, batched)))
    bottom = hier_bottom(base, settle(keyed_edges(statics)), h, methods).drop("fold")
    if bottom_only:
        return bottom
    return all_levels(settle(bottom), statics, methods).join(base_long(base, h).drop("fold"), ["level_idx", "unique_id", "ds"]).select(
        "level_idx", "level", "unique_id", "ds", "base", *methods
    )


def all_levels(bottom: DataFrame, statics: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Bottom rows ``unique_id, ds, <measure>...`` summed to every node: ``level_idx, level, unique_id, ds, <measure>...``."""
    placed = bottom.join(statics.select("unique_id", *PLACE_PRODUCT), "unique_id")
    return roll_up(placed, measures, ["ds"]).withColumnRenamed("node", "unique_id")


def base_long(base: DataFrame, h: int) -> DataFrame:
    """``fold, level_idx, unique_id, ds, base``: the nodes' own forecasts."""
    level = F.split_part("node_id", F.lit(":"), F.lit(1)).cast("int").alias("level_idx")
    node = F.expr("substr(node_id, instr(node_id, ':') + 1)").alias("unique_id")
    rows = base.select("fold", level, node, F.posexplode("y_hat").alias("_k", "base"))
    return rows.select("fold", "level_idx", "unique_id", F.date_add(F.col("fold").cast("date"), F.col("_k") + 1).alias("ds"), "base")


def cv_hier(
    panel: DataFrame,
    statics: DataFrame,
    h: int,
    points: Sequence[Column],
    methods: Sequence[str] = ("BU", "MinT_OLS"),
    model: SeriesModel | BatchModel | None = None,
    *,
    batched: bool = False,
) -> DataFrame:
    """Backtest: ``unique_id, ds, cutoff, y, <method>...``.

    The fold is a key of the base forecasts and of every system solved, so there is one lineage for all folds;
    every fold is reconciled with its own fitted values (no look-ahead).
    """
    base, ahead = with_ahead(node_base(panel, h, points, _batch(model, batched)), methods)
    forecast = hier_bottom(base, settle(keyed_edges(statics)), h, methods, ahead).withColumn("cutoff", F.col("fold").cast("date")).drop("fold")
    truth = fold_test(panel, list(points), h).select("unique_id", "ds", "cutoff", F.col("y").cast("double").alias("y"))
    return truth.join(forecast, ["unique_id", "ds", "cutoff"])


def gradients(base: DataFrame, edges: DataFrame, h: int, methods: Sequence[str], ahead: DataFrame | None = None) -> DataFrame:
    """``fold, unique_id, ds, <method>...``: how far the solution of each least-squares method is from its condition."""
    parts = []
    for m in methods:
        some, method = base if ahead is None or m not in NO_HISTORY else ahead, TRACE_METHODS[m]
        given = weighted(some, edges, method)
        solution = settle(recon_mintrace(some, edges, h, method, given=given))
        parts.append(_long(mintrace_gradient(some, edges, solution, h, method, given=given), h, m))
    return reduce(lambda a, b: a.join(b, ["fold", "unique_id", "ds"]), parts)
