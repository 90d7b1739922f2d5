"""Resharding with the fewest moved bytes, as a minimum-cost flow from old shards to new capacities.

The ``m`` largest old shards keep their place as new shards; bytes that stay cost nothing, moved bytes cost one each.
The flow from old sizes to equal new capacities is solved by successive shortest paths on at most ``2m + 1`` nodes (old
shards without a place of their own are one supply, dealt back in order). It becomes byte ranges of old shards.

An old shard is a row of blocks of about ``BLOCK_BYTES``, by a hash of the row. A block inside one range goes as a whole.
In the few blocks that a range's border cuts, rows are dealt one by one, largest first, to the range with most room
left, so new sizes differ from equal ones by about a short row. Only sizes of old shards reach the driver. Shards that
neither lose nor gain a row aren't rewritten.

Size of a row: UTF-8 bytes of its text (null: none) plus 1. Rows alike in doc_id and text move together.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import fresh_path, settle

BLOCK_BYTES = 2 << 20


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest flow from supplies to demands of the same total, by successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, want = list(supply), list(demand)
    potential = [0] * (n + m)
    while any(left):
        distance: list[float] = [float("inf")] * (n + m)
        before = [-1] * (n + m)
        queue = []
        for i in range(n):
            if left[i]:
                distance[i] = 0
                queue.append((0, i))
        while queue:
            d, u = heapq.heappop(queue)
            if d > distance[u]:
                continue
            steps = (
                ((n + j, cost[u][j]) for j in range(m))
                if u < n
                else ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            )
            for v, c in steps:
                new = d + c + potential[u] - potential[v]
                if new < distance[v]:
                    distance[v], before[v] = new, u
                    heapq.heappush(queue, (new, v))
        end = min((j for j in range(m) if want[j]), key=lambda j: distance[n + j] + potential[n + j])
        for v in range(n + m):
            if distance[v] < float("inf"):
                potential[v] += distance[v]
        path, v = [], n + end
        while before[v] >= 0:
            path.append((before[v], v))
            v = before[v]
        amount = min([left[v], want[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        want[end] -= amount
    return flow


def transfers(old: dict[str, int], shards: int) -> tuple[list[tuple[str, int, int, int]], dict[str, int]]:
    """(old shard, from byte, to byte, new shard), and the new shard that each of the largest old ones becomes."""
    names = sorted(old, key=lambda s: (-old[s], s))
    home = {s: j for j, s in enumerate(names[:shards])}
    total = sum(old.values())
    demand = [total // shards + (j < total % shards) for j in range(shards)]
    rest = names[shards:]
    supply = [old[s] for s in names[:shards]] + [sum(old[s] for s in rest)]
    cost = [[int(home.get(s) != j) for j in range(shards)] for s in names[:shards]] + [[1] * shards]
    flow = min_cost_flow(supply, demand, cost)
    ranges: list[tuple[str, int, int, int]] = []
    for s in names[:shards]:
        at = 0
        i = home[s]
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if flow[i][j]:
                ranges.append((s, at, at + flow[i][j], j))
                at += flow[i][j]
    given = flow[-1]
    j = 0
    for s in rest:
        at = 0
        while at < old[s]:
            while not given[j]:
                j += 1
            part = min(given[j], old[s] - at)
            ranges.append((s, at, at + part, j))
            given[j] -= part
            at += part
    return ranges, home


def deal(rows: pd.DataFrame, parts: list[tuple[int, int]]) -> list[int]:
    """New shard of each row: largest first, to the part (shard, bytes) with most room left."""
    room = [[b, s] for s, b in parts]
    out = [0] * len(rows)
    for at in sorted(range(len(rows)), key=lambda r: (-rows["bytes"].iloc[r], rows["row_key"].iloc[r])):
        best = max(room, key=lambda p: (p[0], -p[1]))
        best[0] -= int(rows["bytes"].iloc[at])
        out[at] = best[1]
    return out


def placements(rows: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[int]]:
    """(row_key, shard, first_slot) of each distinct row, and the shards that change.

    ``rows``: row_key, old_shard, size. Rows with one key count to the first of their old shards.
    """
    spark = rows.sparkSession
    alike = settle(rows.groupBy("row_key").agg(F.min("old_shard").alias("old_shard"), F.count("*").alias("n"), F.sum("size").alias("bytes")))
    old = {r["old_shard"]: int(r["b"]) for r in alike.groupBy("old_shard").agg(F.sum("bytes").alias("b")).collect()}
    ranges, home = transfers(old, shards)
    lost = {home[s] for s, _, _, j in ranges if s in home and home[s] != j}
    changed = sorted(lost | {j for s, _, _, j in ranges if home.get(s) != j})
    cuts = spark.createDataFrame(ranges, "old_shard string, low long, high long, shard int")
    extent = spark.createDataFrame([(s, max(1, -(-b // block_bytes))) for s, b in old.items()], "old_shard string, blocks long")
    items = settle(
        alike.join(extent, "old_shard")
        .withColumn("block", F.pmod("row_key", "blocks"))
        .drop("blocks")
    )
    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = items.groupBy("old_shard", "block").agg(F.sum("bytes").alias("b")).withColumn("start", F.coalesce(F.sum("b").over(before), F.lit(0)))
    met = blocks.join(cuts, "old_shard").withColumn("part", F.least("high", F.col("start") + F.col("b")) - F.greatest("low", "start")).filter("part > 0")
    sides = settle(
        met.groupBy("old_shard", "block").agg(F.sort_array(F.collect_list(F.struct("shard", "part"))).alias("parts"))  # ranges within one block
    )

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(p["shard"]), int(p["part"])) for p in pdf["parts"].iloc[0]]
        return pdf[["old_shard", "block", "row_key", "n", "bytes"]].assign(shard=deal(pdf, parts))

    columns = ["old_shard", "block", "row_key", "n", "bytes"]
    whole = items.join(sides.filter("size(parts) = 1"), ["old_shard", "block"]).select(*columns, F.col("parts")[0]["shard"].alias("shard"))
    dealt = (
        items.join(sides.filter("size(parts) > 1"), ["old_shard", "block"])
        .groupBy("old_shard", "block")
        .applyInPandas(split, "old_shard string, block long, row_key long, n long, bytes long, shard int")
    )
    placed = settle(whole.unionByName(dealt))
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    inside = Window.partitionBy("shard", "old_shard", "block").orderBy("row_key").rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, ["shard", "old_shard", "block"])
    return slots.select("row_key", "shard", (F.col("base") + F.col("inside")).alias("first_slot")), changed


def reshard(docs: DataFrame, shards: int = 8, old_shard=None) -> DataFrame:
    """``docs`` with shard and slot, read back from the rewritten files.

    ``old_shard``: column naming each row's present shard; by default the file it was read from. Extra columns stay.
    """
    marked = docs.withColumns(
        {
            "row_key": F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull()),
            "old_shard": (F.input_file_name() if old_shard is None else old_shard.cast("string")),
            "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1,
        }
    )
    places, changed = placements(marked.select("row_key", F.coalesce("old_shard", F.lit("")).alias("old_shard"), "size"), shards)
    again = Window.partitionBy("row_key").orderBy(F.lit(0))  # the join below uses this exchange
    own = marked.drop("old_shard", "size").withColumn("copy", F.row_number().over(again) - 1)
    moved = (
        own.join(places, "row_key")
        .withColumn("slot", F.col("first_slot") + F.col("copy"))
        .drop("row_key", "copy", "first_slot")
    )
    if not changed:
        return moved
    path = fresh_path(docs.sparkSession, "shards")
    moved.filter(F.col("shard").isin(changed)).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    back = docs.sparkSession.read.schema(moved.schema).parquet(path)
    if len(changed) == shards:
        return back
    return back.unionByName(moved.filter(~F.col("shard").isin(changed)))
