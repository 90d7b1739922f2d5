"""Direct least-squares reconciliation in two passes over blocks of bottom series.

``S' W^-1 S b = S' W^-1 y`` with W = diag(w) or, for the shrunken covariance, W = diag(w) + R R'. Bottom series that share
an item are a *block*. Nodes whose bottom series lie in one block (the series, its item, its item in a state) are local
to it; the others (total, states, stores, categories, departments and their crossings) are the *border*, and so are
the columns of R, one per day. Within a block the system is solved from its own nodes; blocks only meet in the border:

    (Theta^-1 + sum F V F') mu = Phi - sum F s,        b = s + V F' mu

where, per block, ``s`` and ``V`` are solution and inverse of the local system and F the rows of the border (sums
for nodes, residual sums for days). The first pass adds up the matrix of the border, the driver solves it, the second
pass puts mu back. Rows are shuffled once, by block; both passes read the same partitions. All variances enter as w, never
as 1 / w, so constant nodes do no harm. A task's share of the border's matrix is as large as the whole matrix, so there are no more
tasks than these shares stay below the rows themselves.

Only products of the nodes' residuals count. Where a fold has no more nodes than days, its residuals are turned into the lower
triangle of their LQ factors (``shrinkage``): as many columns as nodes instead of days, with the same products.

The border's size doesn't grow with the number of items, but it does with stores x departments and with days: it is
counted first, and ``solve`` returns None beyond ``BORDER`` rows or ``BORDER_BYTES``; callers then iterate instead.
A *fold* is a key of rows and border, so a whole backtest is one job per pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.session import settle, stored

BORDER = 4096  # nodes and days whose matrix the driver solves
BORDER_BYTES = 256 << 20  # their values, which every task reads
VAR_FLOOR = 1e-8  # least variance of a node's residuals
LEAST_SHRINKAGE = 1e-4


def with_fold(df: DataFrame) -> DataFrame:
    return df if "fold" in df.columns else df.withColumn("fold", F.lit(""))


def with_block(edges: DataFrame) -> DataFrame:
    """Edges name the block of a bottom series; without one every series is a block."""
    return edges if "block" in edges.columns else edges.withColumn("block", F.col("bottom_id"))


# --- sums of matrices over all rows ----------------------------------------------------------


def summed(rows: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[tuple[str, np.ndarray]]], *, mirrored: bool = False) -> dict[str, np.ndarray]:
    """Per fold the sum of the matrices ``fn`` makes of a partition: added up per task, then per matrix row.

    Of a ``mirrored`` matrix (its first columns are symmetric) only what is right of the diagonal is sent.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for fold, part in fn(batches):
            if fold in total:
                total[fold] += part
            else:
                total[fold] = part.copy()
        for fold, m in total.items():
            for at in range(0, len(m), 256):
                some = m[at : at + 256]
                sent = [np.ascontiguousarray(r[at + k if mirrored else 0 :]).tobytes() for k, r in enumerate(some)]
                yield pd.DataFrame({"fold": fold, "t": np.arange(at, at + len(some)), "v": sent})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.groupby(["fold", "t"])["v"].agg(lambda vs: np.sum([np.frombuffer(v) for v in vs], axis=0).tobytes())
        return out.reset_index()[["fold", "t", "v"]]

    parts = rows.mapInPandas(partial, "fold string, t int, v binary")
    band = F.floor(F.col("t") / 16).alias("band")
    merged = parts.groupBy("fold", band).applyInPandas(merge, "fold string, t int, v binary")
    got: dict[str, dict[int, bytes]] = {}
    for r in merged.toLocalIterator():  # a partition at a time
        got.setdefault(r["fold"], {})[r["t"]] = bytes(r["v"])
    out = {}
    for fold in sorted(got):
        lines = got.pop(fold)
        n, width = len(lines), len(lines[0]) // 8
        out[fold] = m = np.zeros((n, width))
        for t in range(n):
            v = np.frombuffer(lines.pop(t))
            m[t, width - len(v) :] = v
            if mirrored:
                m[t + 1 :, t] = m[t, t + 1 : n]
    return out


def standardise(actual: np.ndarray, fitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centred residuals over their deviation (zeros without variance), and the variance; NaN is no residual."""
    res = actual - fitted
    known = np.isfinite(res)
    days = np.maximum(known.sum(axis=1, keepdims=True), 1)
    res = np.where(known, res, 0.0)
    res = np.where(known, res - res.sum(axis=1, keepdims=True) / days, 0.0)
    raw = (res**2).sum(axis=1) / days[:, 0]
    var = np.maximum(raw, VAR_FLOOR)
    return np.where(raw[:, None] > VAR_FLOOR, res / np.sqrt(var)[:, None], 0.0), var


def _by_fold(pdf: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    for fold, part in pdf.groupby("fold", sort=False):
        yield str(fold), part


def _values(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Arrays given as bytes as a matrix: of one length, or without their zeros at the end where there is a ``width``."""
    if width is None:
        return np.frombuffer(b"".join(column), dtype=float).reshape(len(column), -1)
    out = np.zeros((len(column), width))
    for row, v in zip(out, column):
        row[: len(v) // 8] = np.frombuffer(v)
    return out


def _dealt(rows: DataFrame, folds: int, parts: int) -> DataFrame:
    """Rows by fold and ``parts`` ranges of the hash of their block or node."""
    key = F.coalesce("block", "node_id") if "block" in rows.columns else F.col("node_id")
    return rows.repartition(max(folds, 1) * parts, F.col("fold"), F.pmod(F.xxhash64(key), F.lit(parts)))


@dataclass
class Shrinkage:
    """W = lam D + (1 - lam) X' X with standardised residuals X of ``days`` days in ``side`` columns; ``inner`` is Q = I + R' (lam D)^-1 R."""

    lam: float
    days: int
    side: int
    inner: np.ndarray | None

    @classmethod
    def of(cls, lam: float, days: int, gram: np.ndarray) -> Shrinkage:
        return cls(lam, days, len(gram), np.eye(len(gram)) + (1 - lam) / (days * lam) * gram)

    @property
    def light(self) -> Shrinkage:
        """What tasks need of it."""
        return replace(self, inner=None)

    @property
    def factor(self) -> float:
        """R' W_d^-1 of a node is this number times x / sqrt(d)."""
        return float(np.sqrt((1 - self.lam) / self.days)) / self.lam


def shrinkage(rows: DataFrame, nodes: int, intensity: Callable[[np.ndarray, float, float], float]) -> tuple[DataFrame, dict[str, Shrinkage]]:
    """The rows ``fold, node_id, y, w, x`` and the shrinkage of every fold, of about ``nodes`` nodes each.

    With no more nodes than days a task has a whole fold and turns its residuals to as many columns as it has nodes. Else
    (days x days) matrices are added up in as many tasks as the nodes need to be more than days.
    """
    head = rows.select(F.octet_length("x").alias("n")).first()
    if head is None:
        return rows, {}
    if nodes <= head["n"] // 8:
        return _turned(rows, intensity)
    rows = settle(rows)

    def run(batches):
        for pdf in batches:
            for fold, part in _by_fold(pdf):
                x = _values(part["x"])
                days = x.shape[1]
                own = (x**2).sum(axis=1, keepdims=True) / days
                more = np.zeros((1, days + 2))
                more[0, -2:] = (own**2).sum(), ((x**2 - own) ** 2).sum()
                yield fold, np.vstack([np.hstack([x.T @ x, np.zeros((days, 2))]), more])

    out = {}
    folds = rows.select("fold").distinct().count()
    for fold, m in summed(_dealt(rows.select("fold", "node_id", "x"), folds, -(-nodes // (head["n"] // 8))), run).items():
        days, gram = len(m) - 1, m[:-1, :-2]
        out[fold] = Shrinkage.of(max(intensity(gram, float(m[-1, -2]), float(m[-1, -1])), LEAST_SHRINKAGE), days, gram)
    return rows, out


def _turned(rows: DataFrame, intensity: Callable[[np.ndarray, float, float], float]) -> tuple[DataFrame, dict[str, Shrinkage]]:
    """``shrinkage`` of folds that fit a task: X = L Q with orthogonal Q, so L has the products of X; its rows end at the diagonal."""

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        x = _values(pdf["x"])
        days = x.shape[1]
        own = (x**2).sum(axis=1, keepdims=True) / days
        lam = max(intensity(x.T @ x, float((own**2).sum()), float(((x**2 - own) ** 2).sum())), LEAST_SHRINKAGE)
        low = np.linalg.qr(x.T, mode="r").T
        return pdf.assign(x=[np.trim_zeros(r, "b").tobytes() for r in low], lam=lam, days=days)

    schema = "fold string, node_id string, y binary, w double, x binary"
    rows = stored(rows.groupBy("fold").applyInPandas(turn, schema + ", lam double, days int"))
    out = {}
    for r in rows.groupBy("fold").agg(F.first("lam").alias("lam"), F.first("days").alias("days"), F.count("*").alias("n")).collect():
        low = _values([v["x"] for v in rows.where(F.col("fold") == r["fold"]).select("x").collect()], min(r["n"], r["days"]))
        out[r["fold"]] = Shrinkage.of(r["lam"], r["days"], low.T @ low)
    return rows.drop("lam", "days"), out


# --- the bordered system ---------------------------------------------------------------------


@dataclass
class Border:
    """The upper nodes of a fold and its shrinkage."""

    place: dict[str, int]
    y: np.ndarray
    w: np.ndarray
    z: np.ndarray | None  # factor * x / sqrt(d), a row per node
    shrink: Shrinkage | None

    @property
    def size(self) -> int:
        return len(self.place) + (self.shrink.side if self.shrink else 0)


def _scaled(part: pd.DataFrame, shrink: Shrinkage | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Variances of the diagonal, and factor * x / sqrt(d)."""
    d = np.maximum(part["w"].to_numpy(dtype=float), VAR_FLOOR * VAR_FLOOR)
    if shrink is None:
        return d, None
    return d * shrink.lam, shrink.factor * _values(part["x"], shrink.side) / np.sqrt(d)[:, None]


@dataclass
class Block:
    """Local solution ``s`` and inverse ``v`` of a block, and its rows of the border: sums ``f`` at ``at``, days ``days``."""

    ids: list[str]
    s: np.ndarray
    v: np.ndarray
    f: np.ndarray
    at: np.ndarray
    days: np.ndarray | None  # days x bottom
    pull: np.ndarray | None  # R' W_d^-1 y of the local nodes


def _block(part: pd.DataFrame, border: Border, h: int) -> Block | None:
    own = part["bottom"].to_numpy(dtype=bool)
    if not own.any():
        return None
    bottom, local = part[own], part[~own]
    place = {n: k for k, n in enumerate(local["node_id"])}
    above = np.zeros((len(local), len(bottom)))
    upper: dict[int, list[int]] = {}
    for j, names in enumerate(bottom["above"]):
        for name in names:
            if name in place:
                above[place[name], j] = 1.0
            elif name in border.place:
                upper.setdefault(border.place[name], []).append(j)
    at = np.array(sorted(upper), dtype=int)
    f = np.zeros((len(at), len(bottom)))
    for row, k in enumerate(at):
        f[row, upper[k]] = 1.0
    y_b, y_l = _values(bottom["y"]), _values(local["y"]) if len(local) else np.zeros((0, h))
    w_b, z_b = _scaled(bottom, border.shrink)
    w_l, z_l = _scaled(local, border.shrink)
    spread = above * w_b
    gain = np.linalg.solve(np.diag(w_l) + spread @ above.T, spread).T if len(local) else np.zeros((len(bottom), 0))
    v = np.diag(w_b) - gain @ spread
    s = y_b + gain @ (y_l - above @ y_b)
    days = pull = None
    if border.shrink is not None:
        days = (z_b + above.T @ z_l + f.T @ border.z[at]).T
        pull = z_b.T @ y_b + z_l.T @ y_l
    return Block(list(bottom["node_id"]), s, v, f, at, days, pull)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The complete (block, fold) groups of sorted batches."""
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        block, fold = pdf["block"].to_numpy(), pdf["fold"].to_numpy()
        edges = np.flatnonzero((block[1:] != block[:-1]) | (fold[1:] != fold[:-1])) + 1
        starts = [0, *edges.tolist()]
        for a, b in zip(starts, starts[1:]):
            yield pdf.iloc[a:b]
        held = pdf.iloc[starts[-1] :]
    if held is not None:
        yield held


def block_rows(base: DataFrame, edges: DataFrame) -> DataFrame:
    """``fold, block, node_id, bottom, above, y, w[, x]``: local nodes by block, border nodes with a null block."""
    spans = edges.groupBy("node_id").agg(F.min("block").alias("block"), (F.min("block") == F.max("block")).alias("_local"), F.max("is_bottom").alias("bottom"))
    spans = spans.select("node_id", F.when(F.col("_local"), F.col("block")).alias("block"), "bottom")
    names = edges.groupBy("bottom_id").agg(
        F.max(F.when(F.col("is_bottom"), F.col("node_id"))).alias("node_id"), F.collect_set(F.when(~F.col("is_bottom"), F.col("node_id"))).alias("above")
    )
    keyed = base.join(spans.join(names.drop("bottom_id"), "node_id", "left"), "node_id")
    return keyed.select("fold", "block", "node_id", "bottom", "above", "y", "w", *[c for c in ("x",) if c in base.columns])


def solve(rows: DataFrame, h: int, shrink: dict[str, Shrinkage] | None = None, *, limit: int | None = None) -> DataFrame | None:
    """``fold, node_id, k1..kh`` of the bottom nodes from ``block_rows``, or None if the border is too large."""
    limit = BORDER if limit is None else limit
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("fold").agg(F.count(F.when(F.col("block").isNull(), 1)).alias("n"), F.count("*").alias("rows")).collect()
    folds, nodes, total = [r["fold"] for r in sizes], max((r["n"] for r in sizes), default=0), sum(r["n"] for r in sizes)
    days = max((s.side for s in shrink.values()), default=0) if shrink else 0
    if nodes + days > limit or total * (h + days) * 8 > BORDER_BYTES:
        return None
    # one shuffle: local rows by block, border rows spread; the shares of the border's matrix are no more than the rows
    share = (nodes + days + 1) * (nodes + days + 2 * h)
    parts = max(1, min(parts, max((r["rows"] for r in sizes), default=0) * (days + h) // share))
    rows = settle(_dealt(rows, len(folds), parts).sortWithinPartitions("block", "fold"))
    borders: dict[str, Border] = {}
    pdf = rows.filter(F.col("block").isNull()).drop("above").toPandas()
    for fold in folds:
        part = pdf[pdf["fold"] == fold].sort_values("node_id")
        some = shrink[fold].light if shrink else None
        w, z = _scaled(part, some)
        y = _values(part["y"]) if len(part) else np.zeros((0, h))
        borders[fold] = Border({n: k for k, n in enumerate(part["node_id"])}, y, w, z, some)
    shared = rows.sparkSession.sparkContext.broadcast(borders)
    local = rows.filter(F.col("block").isNotNull())

    def forward(batches):
        total: dict[str, np.ndarray] = {}
        for part in _groups(batches):
            fold = str(part["fold"].iloc[0])
            border = shared.value[fold]
            found = _block(part, border, h)
            if found is None:
                continue
            n, k = border.size, len(border.place)
            m = total.setdefault(fold, np.zeros((n, n + 2 * h)))
            at = found.at
            fv = found.f @ found.v
            m[np.ix_(at, at)] += fv @ found.f.T
            m[at, n : n + h] += found.f @ found.s
            if found.days is not None:
                cross = fv @ found.days.T
                m[at, k:n] += cross
                m[k:, at] += cross.T
                m[k:, k:n] += found.days @ found.v @ found.days.T
                m[k:, n : n + h] += found.days @ found.s
                m[k:, n + h :] += found.pull
        yield from total.items()

    sums = summed(local, forward, mirrored=True)
    answers = {}
    for fold, border in borders.items():
        n, k = border.size, len(border.place)
        m = sums.pop(fold, np.zeros((n, n + 2 * h)))
        if not n:
            answers[fold] = np.zeros((0, h))
            continue
        matrix, aim = m[:, :n], np.zeros((n, h))
        matrix[np.arange(k), np.arange(k)] += border.w
        aim[:k] = border.y
        if border.shrink:
            matrix[k:, k:] -= shrink[fold].inner
            aim[k:] = m[k:, n + h :] + border.z.T @ border.y
        answers[fold] = np.linalg.solve(matrix, aim - m[:, n : n + h])
    reply = rows.sparkSession.sparkContext.broadcast(answers)
    ks = [f"k{j}" for j in range(1, h + 1)]

    def back(batches):
        for part in _groups(batches):
            fold = str(part["fold"].iloc[0])
            found = _block(part, shared.value[fold], h)
            if found is not None:
                mu, k = reply.value[fold], len(shared.value[fold].place)
                put = found.f.T @ mu[found.at]
                if found.days is not None:
                    put = put + found.days.T @ mu[k:]
                out = pd.DataFrame(found.s + found.v @ put, columns=ks)
                out.insert(0, "node_id", found.ids)
                out.insert(0, "fold", fold)
                yield out

    return local.mapInPandas(back, "fold string, node_id string, " + ", ".join(f"{k} double" for k in ks))


# --- the condition of an optimum, without the solver's algebra --------------------------------


def normal_gradient(solution: DataFrame, base: DataFrame, edges: DataFrame, h: int, shrink: dict[str, Shrinkage] | None = None) -> DataFrame:
    """``fold, bottom_id, k1..kh``: S' W^-1 (S b - y) over the sum of the absolute terms of S' W_d^-1 y; zero at the optimum.

    ``solution`` has ``fold, bottom_id, k1..kh``, ``base`` ``fold, node_id, y, w[, x]``. S and its transpose are joins with the edges.
    """
    ks = [f"k{j}" for j in range(1, h + 1)]
    up = edges.select("bottom_id", "node_id").join(solution, "bottom_id").groupBy("fold", "node_id")
    sums = up.agg(F.array(*[F.sum(k) for k in ks]).alias("u"))
    nodes = base.join(sums, ["fold", "node_id"])
    nodes = settle(nodes) if shrink else nodes
    light = {fold: s.light for fold, s in shrink.items()} if shrink else None

    def gaps(part: pd.DataFrame, some: Shrinkage | None):
        y, u = _values(part["y"]), np.array(part["u"].tolist()).reshape(len(part), -1)
        w, z = _scaled(part, some)
        return (u - y) / w[:, None], np.abs(y) / w[:, None], z, u - y

    answers = None
    if shrink:

        def project(batches):
            for pdf in batches:
                for fold, part in _by_fold(pdf):
                    *_, z, gap = gaps(part, light[fold])
                    yield fold, z.T @ gap

        answers = {fold: np.linalg.solve(shrink[fold].inner, p) for fold, p in summed(nodes, project).items()}

    def weigh(batches):
        for pdf in batches:
            for fold, part in _by_fold(pdf):
                v, size, z, _ = gaps(part, light[fold] if light else None)
                if light:
                    v = v - z @ answers[fold]
                out = pd.DataFrame(np.hstack([v, size]), columns=[*ks, *[f"s_{k}" for k in ks]])
                out.insert(0, "node_id", part["node_id"].to_numpy())
                out.insert(0, "fold", fold)
                yield out

    schema = "fold string, node_id string, " + ", ".join(f"{k} double" for k in [*ks, *[f"s_{k}" for k in ks]])
    down = edges.select("bottom_id", "node_id").join(nodes.mapInPandas(weigh, schema), "node_id")
    down = down.join(solution.select("fold", "bottom_id"), ["fold", "bottom_id"], "left_semi").groupBy("fold", "bottom_id")
    return down.agg(*[(F.sum(k) / F.greatest(F.sum(f"s_{k}"), F.lit(1e-12))).alias(k) for k in ks])




def pack_rows(base: DataFrame, keep: Callable[[pd.DataFrame], dict], extra: str = "", history: bool = True) -> DataFrame:
    """Rows ``fold, node_id, y`` and what ``keep`` makes of (actual, fitted), arrays as bytes; without ``history`` these aren't read."""

    def run(batches):
        for pdf in batches:
            out = {"fold": pdf["fold"], "node_id": pdf["node_id"], "y": [np.asarray(v, dtype=float).tobytes() for v in pdf["y_hat"]]}
            yield pd.DataFrame({**out, **keep(pdf)})

    return base.select("fold", "node_id", "y_hat", *(["actual", "fitted"] if history else [])).mapInPandas(run, "fold string, node_id string, y binary" + extra)
