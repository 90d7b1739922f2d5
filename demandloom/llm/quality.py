"""Quality scores of documents by regularised quadratic discriminant analysis.

* **Statistics.** Every whole text becomes ``len(NAMES)`` numbers: log sizes, and log odds (with half a count added) of
  shares such as capitals, symbols, distinct or repeated words, repeated lines. Logs make them roughly normal.
* **Class densities.** Moments (count, sum, sum of outer products) by class and fold are summed over *all* labelled rows
  that aren't held out; a task sends one row. A class covariance is shrunk towards the pooled one (``POOL``) and then
  towards the mean variance times the identity (``ROUND``), all on statistics scaled by their pooled deviation.
* **Choice of shrinkage.** Moments add up, so those without a fold are a subtraction: all pairs of (POOL, ROUND) are
  fitted without each of ``FOLDS`` folds and their log loss on that fold is summed in one pass.
* **Score.** The posterior of label 1: log share of the classes plus the difference of log densities. The inverse
  Cholesky factor of each class is computed once on the driver, so that a squared Mahalanobis distance is
  the squared length of a product.

Only the text is an input of a score. Null and empty texts have the statistics of a text without characters. Label rows
with null ids, or labels other than 0 and 1, take no part; of several label rows of a doc_id the largest label counts.
Without labelled rows of both classes every score is the share of label 1 (0.5 without labels). Repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import release, rows_of, saved, take_memory

NAMES = (
    "characters", "words", "word_length", "word_spread", "capitals", "digits", "symbols", "marks", "pipes", "foreign",
    "distinct", "commonest", "repeats", "lines", "line_length", "line_repeats", "short_words", "first_capitals",
)
FOLDS = 4
POOL = (0.0, 0.05, 0.2, 0.5, 1.0)
ROUND = (0.001, 0.01, 0.05, 0.2)
GOOD_FROM = 0.7
_ODD = 4.0  # rows this many pooled deviations out count as that far: no single number decides alone

_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*<=>@[\\]^_`{}~+/"
_MARKS = b"!?"
_HIGH = bytes(range(0xC0, 0x100))
_CONTINUATION = bytes(range(0x80, 0xC0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The numbers of NAMES of a UTF-8 text."""
    words = text.split()
    lines = text.split(b"\n")
    n, size = len(words), len(text)
    points = len(text.translate(None, _CONTINUATION))
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)

    def held(drop: bytes) -> int:
        return size - len(text.translate(None, drop))

    lengths = np.log1p(sizes) if n else np.zeros(1)
    # distinct words grow with the text: compared with a power of the number of words
    return [
        float(np.log1p(points)),
        float(np.log1p(n)),
        float(lengths.mean()),
        float(np.log(lengths.std() + 0.05)),
        _odds(held(_CAPITALS), points),
        _odds(held(_DIGITS), points),
        _odds(held(_SYMBOLS), points),
        _odds(held(_MARKS), points),
        _odds(held(b"|"), points),
        _odds(held(_HIGH), points),
        float(np.log1p(len(counts)) - 0.8 * np.log1p(n)),
        _odds(max(counts.values(), default=0), n),
        _odds(sum(map(bytes.__eq__, words, words[1:])), n),
        float(np.log(len(lines))),
        float(np.log1p(points / len(lines))),
        _odds(len(lines) - len(set(lines)), len(lines)),
        _odds(int((sizes <= 3).sum()), n),
        _odds(sum(1 for w in words if 65 <= w[0] <= 90), n),
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of (doc_id, text): the only pass over texts."""

    def run(batches):
        import pyarrow as pa

        take_memory("quality", lambda: None)
        for batch in batches:
            for part in rows_of(batch, 1024):
                x = [statistics(t.as_py() or b"") for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])
        release()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, x array<double>")


# ---------------------------------------------------------------- model


@dataclass
class Moments:
    """Count, sum and sum of outer products of one class's statistics."""

    n: float
    total: np.ndarray
    square: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.square - other.square)

    def scatter(self) -> np.ndarray:
        return self.square - np.outer(self.total, self.total) / self.n


@dataclass
class Discriminant:
    """Scaled class densities: means, inverse Cholesky factors, and constants of the log densities (shares included)."""

    shift: np.ndarray
    scale: np.ndarray
    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    constant: list[float]

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.shift) / self.scale, -_ODD, _ODD)
        density = [self.constant[k] - 0.5 * (((z - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return density[1] - density[0]


def shrunk(scatter: np.ndarray, n: float, pooled: np.ndarray, pool: float, round_: float) -> np.ndarray:
    """Class covariance moved towards the pooled one, then towards its mean variance times the identity."""
    cov = (1 - pool) * scatter / n + pool * pooled
    return (1 - round_) * cov + round_ * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))


def discriminant(classes: list[Moments], shift: np.ndarray, scale: np.ndarray, pool: float, round_: float) -> Discriminant:
    """Fitted on moments of scaled statistics."""
    whole = sum(c.n for c in classes)
    pooled = sum(c.scatter() for c in classes) / whole
    means, whiten, constants = [], [], []
    for c in classes:
        factor = np.linalg.cholesky(shrunk(c.scatter(), c.n, pooled, pool, round_))
        means.append(c.total / c.n)
        whiten.append(np.linalg.inv(factor))
        constants.append(float(np.log(c.n / whole) - np.log(np.diag(factor)).sum()))
    return Discriminant(shift, scale, means, whiten, constants)


def _moments(rows: DataFrame, shift: np.ndarray, scale: np.ndarray) -> dict[tuple[int, int], Moments]:
    """Moments of the scaled statistics by (label, fold); a task sends 2 * FOLDS rows at most."""
    p = len(shift)

    def run(batches):
        import pyarrow as pa

        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z = np.clip((x - shift) / scale, -_ODD, _ODD)
            label, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for key in set(zip(label.tolist(), fold.tolist())):
                of = z[(label == key[0]) & (fold == key[1])]
                part = np.concatenate([[len(of)], of.sum(axis=0), (of.T @ of).ravel()])
                sums[key] = sums.get(key, 0) + part
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["label", "fold", "sums"],
        )

    parts = rows.select("x", "label", "fold").mapInArrow(run, "label int, fold int, sums array<double>")
    each = parts.select("label", "fold", F.posexplode("sums").alias("k", "v")).groupBy("label", "fold", "k").agg(F.sum("v").alias("v"))
    found: dict[tuple[int, int], np.ndarray] = {}
    for r in each.collect():  # 2 * FOLDS * (1 + p + p * p) numbers
        found.setdefault((r["label"], r["fold"]), np.zeros(1 + p + p * p))[r["k"]] = r["v"]
    return {key: Moments(v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)) for key, v in found.items()}


def _losses(rows: DataFrame, models: dict[int, list[Discriminant]]) -> np.ndarray:
    """Summed log loss of every model on the rows of its own fold."""
    many = len(POOL) * len(ROUND)

    def run(batches):
        import pyarrow as pa

        loss = np.zeros(many)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            label, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for f in set(fold.tolist()) & set(models):
                of = fold == f
                sign = np.where(label[of] == 1, -1.0, 1.0)
                loss += [np.logaddexp(0, sign * np.clip(m.logit(x[of]), -30, 30)).sum() for m in models[f]]
        yield pa.RecordBatch.from_arrays([pa.array(range(many), pa.int32()), pa.array(loss)], names=["k", "loss"])

    sums = rows.select("x", "label", "fold").mapInArrow(run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    out = np.zeros(many)
    for r in sums:
        out[r["k"]] = r["loss"]
    return out


@dataclass
class Model:
    """A discriminant, or the logit that all texts get where a class is missing."""

    discriminant: Discriminant | None
    flat: float
    pool: float = 0.0
    round: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.discriminant.logit(x) if self.discriminant else np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Train on all rows of ``described`` documents that have a ``quality`` label and aren't held out."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")
    rows = saved(stats.join(usable, "doc_id").withColumn("fold", fold), "quality-rows")
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2 or min(seen.values()) < 2:
        share = (seen.get(1, 0) + 0.5) / (sum(seen.values()) + 1)
        return Model(None, float(np.log(share / (1 - share))))
    p = len(NAMES)
    ends = rows.select(*[F.avg(F.col("x")[k]) for k in range(p)], *[F.stddev_pop(F.col("x")[k]) for k in range(p)]).first()
    shift, scale = np.array(ends[:p]), np.maximum(np.array(ends[p:]), 1e-3)
    parts = _moments(rows, shift, scale)
    total = [_sum([m for (label, _), m in parts.items() if label == k]) for k in (0, 1)]
    grid = [(a, b) for a in POOL for b in ROUND]
    models = {}
    for f in range(FOLDS):
        rest = [total[k] - parts[k, f] if (k, f) in parts else total[k] for k in (0, 1)]
        if min(m.n for m in rest) >= 2:
            models[f] = [discriminant(rest, shift, scale, a, b) for a, b in grid]
    best = grid[int(np.argmin(_losses(rows, models)))] if models else (0.5, ROUND[-1])
    return Model(discriminant(total, shift, scale, *best), 0.0, *best)


def _sum(parts: list[Moments]) -> Moments:
    return Moments(sum(m.n for m in parts), sum(m.total for m in parts), sum(m.square for m in parts))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of ``described`` documents."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``GOOD_FROM``) of every row. Texts are read once and never shuffled."""
    stats = saved(described(docs), "quality-statistics")
    return score(stats, fit(stats, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")
    )
