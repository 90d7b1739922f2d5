"""Order-based operators (exact quantiles, running totals) that never gather a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer and a window
over a whole model keeps all its series in one task. Both are fine for small groups only, so
the two helpers below spread the work over value buckets or sorted ranges instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandloom.session import settle

_STEPS_PER_OCTAVE = 256
_SHIFT = 300_000  # larger than 1075 octaves x 256 steps, keeps magnitudes positive


def value_bucket(v: Column) -> Column:
    """A number that never decreases with ``v``: 256 log-scale steps per octave and sign."""
    magnitude = F.floor(F.log2(F.abs(v)) * _STEPS_PER_OCTAVE) + _SHIFT
    return F.when(v > 0, magnitude).when(v < 0, -magnitude).otherwise(F.lit(0)).cast("bigint")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], *, out: str = "q"
) -> DataFrame:
    """Linear-interpolated quantiles per key: rows ``keys..., p, <out>``.

    Pass one counts rows per value bucket (combined map-side), which tells in which bucket
    each wanted rank lies; pass two orders only the distinct values of those buckets.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    base = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    base = base.withColumn("_b", value_bucket(F.col("_v")))
    per_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    counts = (
        base.groupBy(*keys, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(per_key.orderBy("_b")))
        .withColumn("_total", F.sum("_n").over(per_key))
    )
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    ranks = (
        counts.withColumn("p", F.explode(wanted))
        .withColumn("_pos", F.col("p") * (F.col("_total") - 1))
        .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .where((F.col("_r") >= F.col("_upto") - F.col("_n")) & (F.col("_r") < F.col("_upto")))
        .select(*keys, "_b", "p", "_pos", "_r", (F.col("_upto") - F.col("_n")).alias("_before"))
    )
    hit = ranks.select(*keys, "_b", "_before").distinct()
    inside = (
        _null_safe_join(base, hit, [*keys, "_b"])
        .groupBy(*keys, "_b", "_before", "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn(
            "_end", F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_b").orderBy("_v"))
        )
    )
    picked = _null_safe_join(ranks.drop("_before"), inside, [*keys, "_b"]).where(
        (F.col("_r") >= F.col("_end") - F.col("_c")) & (F.col("_r") < F.col("_end"))
    )
    low = F.max(F.when(F.col("_r") == F.floor("_pos"), F.col("_v")))
    high = F.max(F.when(F.col("_r") == F.ceil("_pos"), F.col("_v")))
    frac = F.max(F.col("_pos") - F.floor("_pos"))
    return picked.groupBy(*keys, "p").agg((low + frac * (high - low)).alias(out))


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        cond = term if cond is None else cond & term
    return left.join(renamed, cond).drop(*[f"_k_{c}" for c in on])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Running sums (inclusive) per key in a total order, one sorted range per task.

    The rows are range-partitioned on (keys, order), which also splits a hot key, then
    checkpointed so the ranges stay fixed. Each task sums its own range; the sums of the
    earlier ranges of the key come from a table of (key, range) totals, whose size is bounded
    by ranges + keys and therefore broadcast. ``order`` has to be unique within a key.
    """
    keys = list(keys)
    named = {f"_s{i}": c for i, c in enumerate(sums.values())}
    cols = [*[F.col(k) for k in keys], *order]
    laid = settle(
        df.withColumns(named)
        .repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_part", F.spark_partition_id())
    )
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = laid.groupBy(*keys, "_part").agg(*[F.sum(s).alias(s) for s in named])
    offsets = totals.select(
        *keys, "_part", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_o{s}") for s in named]
    )
    local = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = laid.join(F.broadcast(offsets), [*keys, "_part"])
    out = joined.withColumns(
        {name: F.col(f"_o{s}") + F.sum(s).over(local) for name, s in zip(sums, named, strict=True)}
    )
    return out.drop("_part", *named, *[f"_o{s}" for s in named])
