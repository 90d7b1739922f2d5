"""Exact duplicates against a history, by a minimal perfect hash over the history's digests.

The history is reduced to its distinct digests. A digest belongs to a *part* (about ``PART_KEYS`` digests, so one task
builds one part); inside a part the hash-and-displace scheme finds, for each small group of digests, a seed that sends
all of them to free slots, until every one of the ``n`` digests owns one of exactly ``n`` slots. The index is two
ordinary tables:

* ``seeds``: (part, bin) -> seed,
* ``slots``: (part, slot) -> the full 32-byte digest, the winner's locator (largest doc_id) and the group's size.

A lookup computes part and bin from the digest, joins the seed, computes the slot, joins the slot and compares all
bytes of the digest, since a perfect hash sends digests it has never seen to some slot too. Digests that aren't in
the history are grouped among themselves. The joins are ordinary equi-joins, so a hot digest is split by adaptive
execution, and only one row per distinct digest of a delivery is looked up.

Null texts count as empty. Texts are equal if they are identical after lower-casing A-Z only. Rows with a null doc_id
lose against any other row of their group; a group of only such rows keeps one of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import settle

PART_KEYS = 50_000
BIN_KEYS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MASK = (1 << 40) - 1


def normalised(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)  # there the built-in does the same, faster
    return F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def _number(digest: Column, at: int) -> Column:
    """Five bytes of the digest as a non-negative number."""
    return F.conv(F.hex(F.substring(digest, at, 5)), 16, 10).cast("long")


def _slot(a: Column, b: Column, seed: Column, size: Column) -> Column:
    """Negative seeds name the slot outright; others displace the digest's two numbers."""
    mixed = (a.bitwiseXOR((b * (seed % 1021 + 1) + seed * 2654435761).bitwiseAND(F.lit(_MASK)))) % size
    return F.when(seed < 0, -seed - 1).otherwise(mixed)


def _mix(a: np.ndarray, b: np.ndarray, seed: int, size: int) -> np.ndarray:
    return (a ^ ((b * (seed % 1021 + 1) + seed * 2654435761) & _MASK)) % size


def displace(a: np.ndarray, b: np.ndarray, bins: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds per bin and the slot of each key; slots are a permutation of 0..n-1."""
    size = len(a)
    taken = np.zeros(size, dtype=bool)
    seeds = np.zeros(n_bins, dtype=np.int64)
    slots = np.zeros(size, dtype=np.int64)
    order = np.argsort(bins, kind="stable")
    starts = np.searchsorted(bins[order], np.arange(n_bins + 1))
    counts = np.diff(starts)
    by_size = np.argsort(-counts, kind="stable")
    single: list[int] = []
    for j in by_size:
        members = order[starts[j] : starts[j + 1]]
        if len(members) == 0:
            break
        if len(members) == 1:
            single.append(j)
            continue
        pairs = [(int(x), int(y)) for x, y in zip(a[members], b[members])]
        seed = 0
        while True:
            step, shift = seed % 1021 + 1, seed * 2654435761
            found = {(x ^ ((y * step + shift) & _MASK)) % size for x, y in pairs}
            if len(found) == len(pairs) and not any(taken[s] for s in found):
                break
            seed += 1
        at = _mix(a[members], b[members], seed, size)
        taken[at] = True
        seeds[j], slots[members] = seed, at
    free = np.flatnonzero(~taken)
    for j, slot in zip(single, free):
        seeds[j], slots[order[starts[j]]] = -int(slot) - 1, slot
    return seeds, slots


@dataclass
class Index:
    """Minimal perfect hash over distinct digests as two tables, with part sizes beside each seed."""

    parts: int
    seeds: DataFrame
    slots: DataFrame


def _placed(df: DataFrame, parts: int) -> DataFrame:
    """Part and the numbers a lookup needs, from bytes of the digest that don't overlap."""
    return df.withColumns(
        {"a": _number(F.col("digest"), 1), "b": _number(F.col("digest"), 6), "part": (_number(F.col("digest"), 11) % parts).cast("int")}
    )


def groups(docs: DataFrame) -> DataFrame:
    """One row per distinct digest: winner (largest doc_id), size and how many rows carry the winner's doc_id."""
    per_id = docs.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("size"))


def build_index(history: DataFrame, total: int | None = None) -> Index:
    """Index over (digest, winner, size) rows with distinct digests."""
    n = history.count() if total is None else total
    parts = max(1, -(-n // PART_KEYS))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        size = len(pdf)
        bins = -(-size // BIN_KEYS)
        a, b = pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)
        bin_ = b % bins
        seeds, slots = displace(a, b, bin_, bins)
        return pd.DataFrame({"part": pdf["part"], "size_of_part": size, "bins": bins, "bin": bin_, "seed": seeds[bin_], "slot": slots, "digest": pdf["digest"], "winner": pdf["winner"], "size": pdf["size"]})

    built = settle(
        _placed(history, parts)
        .groupBy("part")
        .applyInPandas(part, "part int, size_of_part long, bins long, bin long, seed long, slot long, digest binary, winner long, size long")
    )
    return Index(
        parts,
        built.groupBy("part", "bin").agg(F.first("seed").alias("seed"), F.first("bins").alias("bins"), F.first("size_of_part").alias("size_of_part")),
        built.select("part", "slot", F.col("digest").alias("slot_digest"), F.col("winner").alias("old_winner"), F.col("size").alias("old_size")),
    )


def lookup(keys: DataFrame, index: Index) -> DataFrame:
    """Adds ``old_winner`` and ``old_size`` to (digest, ...) rows; null where the history doesn't hold the digest."""
    extents = index.seeds.groupBy("part").agg(F.first("bins").alias("bins"), F.first("size_of_part").alias("size_of_part"))
    placed = _placed(keys, index.parts).join(extents, "part", "left").withColumn("bin", F.col("b") % F.col("bins"))
    seeded = placed.join(index.seeds.select("part", "bin", "seed"), ["part", "bin"], "left")
    slotted = seeded.withColumn("slot", _slot(F.col("a"), F.col("b"), F.col("seed"), F.col("size_of_part")))
    met = slotted.join(index.slots, ["part", "slot"], "left")
    # byte check: a stranger lands on some slot too
    met = met.withColumn("member", F.coalesce(F.col("slot_digest") == F.col("digest"), F.lit(False)))
    return met.withColumns({c: F.when(F.col("member"), F.col(c)) for c in ("old_winner", "old_size")}).drop(
        "a", "b", "part", "bins", "size_of_part", "bin", "seed", "slot", "slot_digest"
    )


def resolve(docs: DataFrame, is_history: Column) -> DataFrame:
    """Winner and size of every distinct digest of ``docs`` (doc_id, digest), history and delivery together.

    ``is_history`` marks the rows that were there before. Winners of the history come out of the index' slots; a
    delivery's repeats of them update winner and size; its other digests are grouped on their own.
    """
    marked = docs.withColumn("old", F.coalesce(is_history, F.lit(False)))
    history = settle(groups(marked.filter("old")))
    index = build_index(history)
    fresh = groups(marked.filter("not old"))
    looked = settle(lookup(fresh, index))
    repeats = looked.filter("member").select(
        "digest", F.greatest("winner", "old_winner").alias("winner"), (F.col("size") + F.col("old_size")).alias("size")
    )
    strangers = looked.filter("not member").select("digest", "winner", "size")
    untouched = index.slots.select(F.col("slot_digest").alias("digest"), F.col("old_winner").alias("winner"), F.col("old_size").alias("size")).join(
        repeats.select("digest"), "digest", "left_anti"
    )
    return repeats.unionByName(strangers).unionByName(untouched)


def midpoint(docs: DataFrame) -> Column:
    """The first half of the id range as history: a table that arrived in two deliveries."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(False) if low is None else F.col("doc_id") <= F.lit((low + high) // 2)


def mark_duplicates(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with keep_id, group_size, kept and text_sha256; texts aren't shuffled."""
    slim = settle(docs.select("doc_id", digest_of(F.col("text")).alias("digest")))
    decided = resolve(slim, midpoint(slim) if is_history is None else is_history)
    return (
        slim.join(decided, "digest")
        .select(
            "doc_id",
            F.col("winner").alias("keep_id"),
            F.col("size").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_duplicates(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """``docs`` without repeats: of equal texts the row with the largest doc_id, with all its columns.

    Several rows with that doc_id and an equal text leave one of them.
    """
    inner = docs.select(F.col("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest_of(F.col("text")).alias("digest"))
    slim = settle(inner.select("doc_id", "digest"))
    decided = resolve(slim, midpoint(slim) if is_history is None else is_history)
    tied = slim.groupBy("digest", "doc_id").agg(F.count("*").alias("ties"))
    winners = decided.join(
        tied.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"), "ties"),
        (F.col("digest") == F.col("d")) & F.col("winner").eqNullSafe(F.col("i")),
    ).select("d", "i", "ties")
    kept = inner.join(winners, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")))
    once = kept.filter("ties = 1").select("row.*")
    again = kept.filter("ties > 1").groupBy("d", "i").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(again)
