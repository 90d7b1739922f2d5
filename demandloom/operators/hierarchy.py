"""Product-and-place hierarchy: twelve levels, roll-ups and summing edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.functions.expr import need
from demandloom.operators.reshape import densify_panel, latest
from demandloom.session import settle

TOTAL = "Total"
PLACE_PRODUCT = ("state_id", "store_id", "cat_id", "dept_id", "item_id")

# The attribute columns of the twelve levels (each below the total), in order.
LEVELS: tuple[tuple[str, ...], ...] = (
    (),
    ("state_id",),
    ("state_id", "store_id"),
    ("cat_id",),
    ("cat_id", "dept_id"),
    ("state_id", "cat_id"),
    ("state_id", "cat_id", "dept_id"),
    ("state_id", "store_id", "cat_id"),
    ("state_id", "store_id", "cat_id", "dept_id"),
    ("cat_id", "dept_id", "item_id"),
    ("state_id", "cat_id", "dept_id", "item_id"),
    ("state_id", "store_id", "cat_id", "dept_id", "item_id"),
)
BOTTOM = len(LEVELS) - 1

# The twelve levels of the leaderboard notebook, keyed without parents.
PLAIN_LEVELS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("L1_total", ()),
    ("L2_state", ("state_id",)),
    ("L3_store", ("store_id",)),
    ("L4_cat", ("cat_id",)),
    ("L5_dept", ("dept_id",)),
    ("L6_state_cat", ("state_id", "cat_id")),
    ("L7_state_dept", ("state_id", "dept_id")),
    ("L8_store_cat", ("store_id", "cat_id")),
    ("L9_store_dept", ("store_id", "dept_id")),
    ("L10_item", ("item_id",)),
    ("L11_item_state", ("item_id", "state_id")),
    ("L12_item_store", ("item_id", "store_id")),
)


def level_name(cols: Sequence[str]) -> str:
    return "/".join(cols) or TOTAL


LEVEL_NAMES = tuple(level_name(c) for c in LEVELS)


def _level_lookup(group_cols: Sequence[str], levels: Sequence[Sequence[str]]) -> Column:
    """Level index from the grouping id (bit set = column rolled away)."""
    index: Column = F.lit(None).cast("int")
    for i, cols in enumerate(levels):
        gid = 0
        for c in group_cols:
            gid = gid * 2 + (1 if c in PLACE_PRODUCT and c not in cols else 0)
        index = F.when(F.grouping_id() == gid, F.lit(i)).otherwise(index)
    return index


def roll_up(
    df: DataFrame,
    measures: Sequence[str],
    by: Sequence[str] = ("ds",),
    levels: Sequence[Sequence[str]] = LEVELS,
    names: Sequence[str] | None = None,
    node: Column | None = None,
) -> DataFrame:
    """Sums of the measures at every level: ``level_idx, level, node, by..., measures...``.

    One pass with grouping sets; partial aggregation folds the twelve-fold expansion before
    the shuffle, and the node name is only built on the aggregated rows.
    """
    used = [c for c in PLACE_PRODUCT if any(c in lv for lv in levels)]
    need(df, *used, *by, *measures)
    keys = [*used, *by]
    sets = [[F.col(c) for c in (*[u for u in used if u in lv], *by)] for lv in levels]
    names = names or [level_name(lv) for lv in levels]
    node = node if node is not None else F.concat_ws("/", F.lit(TOTAL), *used)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("level_idx") + 1)
    return (
        df.groupingSets(sets, *[F.col(c) for c in keys])
        .agg(*[F.sum(m).alias(m) for m in measures], _level_lookup(keys, levels).alias("level_idx"))
        .select("level_idx", label.alias("level"), node.alias("node"), *by, *measures)
    )


def hier_aggregate(panel: DataFrame, levels: Sequence[Sequence[str]] = LEVELS, end: Column | None = None) -> DataFrame:
    """All levels of a dense panel stacked: ``level_idx, level, unique_id, ds, y``.

    Zero rows add nothing to a sum, so only non-zero rows are rolled up; the missing days of
    each node are filled afterwards, when the rows are few.
    """
    end = latest(panel) if end is None else end
    return level_history(panel, ["y"], levels, end=end).withColumnRenamed("node", "unique_id")


def level_history(
    panel: DataFrame,
    measures: Sequence[str],
    levels: Sequence[Sequence[str]] = LEVELS,
    *,
    end: Column | None = None,
    names: Sequence[str] | None = None,
    node: Column | None = None,
) -> DataFrame:
    """Dense node history from the first non-zero day to ``end`` with the summed measures."""
    end = latest(panel) if end is None else end
    sold = panel.where(F.col("y") != 0)
    nodes = roll_up(sold, measures, ["ds"], levels, names, node)
    keyed = nodes.withColumn("unique_id", F.concat_ws(":", F.col("level_idx").cast("string"), "node"))
    dense = densify_panel(keyed, statics=["level_idx", "level", "node"], fill=measures, until=end)
    return dense.select("level_idx", "level", "node", "ds", *measures)


def hier_edges(statics: DataFrame, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """Sparse summing matrix: one row per (node, bottom series) membership."""
    need(statics, "unique_id", *PLACE_PRODUCT)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("level_idx"),
                F.lit(level_name(lv)).alias("level"),
                F.concat_ws("/", F.lit(TOTAL), *lv).alias("node"),
            )
            for i, lv in enumerate(levels)
        ]
    )
    return statics.select(F.col("unique_id").alias("bottom_id"), F.inline(entries))


def hier_nodes(statics: DataFrame, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """The nodes of each level with their number of bottom series."""
    return hier_edges(statics, levels).groupBy("level_idx", "level", "node").agg(F.count("*").alias("n_bottom"))


def hier_level_counts(statics: DataFrame, levels: Sequence[Sequence[str]] = LEVELS) -> DataFrame:
    """Number of series per level."""
    return hier_nodes(statics, levels).groupBy("level_idx", "level").agg(F.count("*").alias("n_series"))


def hier_extract_bottom(reconciled: DataFrame, statics: DataFrame) -> DataFrame:
    """Keep the bottom nodes of a node frame (``unique_id`` = node) and restore series ids."""
    names = statics.select(F.concat_ws("/", F.lit(TOTAL), *PLACE_PRODUCT).alias("_node"), F.col("unique_id").alias("_id"))
    kept = reconciled.join(names, reconciled["unique_id"] == F.col("_node"))
    return kept.withColumn("unique_id", F.col("_id")).drop("_node", "_id")


def level_weights(components: DataFrame) -> DataFrame:
    """Trailing revenue to a share within its level (left as is where the level sells nothing),
    then without the nodes that have no usable scale."""
    components = settle(components)
    totals = components.groupBy("level_idx").agg(F.sum("trailing_revenue").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("trailing_revenue") / F.col("_total")).otherwise(F.col("trailing_revenue"))
    joined = components.join(F.broadcast(totals), "level_idx")  # one row per level
    return joined.withColumn("weight", share).where(F.col("scale") > 0).drop("_total", "trailing_revenue")


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Row number within small groups (levels, models), never within series-sized ones."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
