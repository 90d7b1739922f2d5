"""Toxicity scores by weak supervision.

* **Voters.** A lexicon of insults (public English words) and word-initial patterns; the patterns are mined from
  labelled training rows as the word beginnings that separate toxic from other documents best (near copies, found by
  the smallest hash of three words, count as one document). Each voter says for each document whether it fires. A hand label, where there is one, is one more (very accurate) voter.
* **Label model.** A two-class generative model gives each voter a rate of firing on toxic and on other documents. It
  is fitted by expectation maximisation; after each fit the correlations that the classes leave between voters are
  estimated, and voters that say the same share one vote.
* **Classifier.** A logistic regression is trained on the posterior labels (as weights of both classes). Features of
  each mined pattern: whether any word shows it, and the number of distinct words that do over the root of the number of
  distinct words.

Everything is learned from rows that aren't held out. Pattern mining, label model and classifier use a bounded
sample of labelled rows (``SAMPLE_ROWS``, drawn by a hash of doc_id); scores cover whole texts of all rows. A text's
words are white-space separated, lower-cased, stripped of punctuation. Only the text is an input of a score.

Null and empty texts get the score of a text without any pattern. Without labelled rows of both kinds every score is the share of
toxic labels (0 without labels).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import rows_of, settle, take_memory
from demandloom.llm.shingles import forget, in_order, words_of

SAMPLE_ROWS = 20_000
PATTERNS = 256
VOTERS = 48
STEMS = (3, 4, 5, 6, 7, 8)
CANDIDATES = 4_000
MEMO = 600_000
REGULARISATION = 1e-6
HAND_RATES = (0.98, 0.005)
TOXIC_FROM = 0.7
# Common English insults.
LEXICON = (
    "idiot", "moron", "stupid", "dumb", "fool", "loser", "pathetic", "worthless", "useless", "trash", "garbage", "scum",
    "filth", "disgusting", "vile", "clown", "jerk", "creep", "pig", "rat", "ugly", "hate", "shut", "kill", "die",
)
_EDGES = "\"'`.,;:!?()[]{}<>*_-#/\\|~«»“”‘’…"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def patterns_of(chunk: str) -> list[str]:
    """Patterns of a lower-cased chunk: its beginnings and ``=word`` itself."""
    word = chunk.strip(_EDGES)
    return [word[:k] for k in STEMS if len(word) > k] + ["=" + word] if word else []


def distinct_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def _counted(sample: DataFrame) -> DataFrame:
    """Per pattern: weight of toxic and of other documents that hold it, from (text, toxic, weight)."""

    def run(batches):
        import pyarrow as pa

        take_memory("toxicity", lambda: None)
        sums = (defaultdict(float), defaultdict(float))
        for batch in batches:
            for text, label, weight in zip(*(c.to_pylist() for c in batch.columns)):
                into = sums[label]
                for p in {p for w in distinct_words(text) for p in patterns_of(w)}:
                    into[p] += weight
        keys = [*sums[1], *(p for p in sums[0] if p not in sums[1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([sums[k].get(p, 0.0) for p in keys], pa.float64()) for k in (1, 0))],
            names=["pattern", "toxic", "other"],
        )

    counts = sample.select("text", "toxic", "weight").mapInArrow(run, "pattern string, toxic double, other double")
    return counts.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def weighed(sample: DataFrame) -> DataFrame:
    """Adds ``weight``: one over the number of rows with the same smallest hash of three words, as near copies have."""

    def run(batches):
        import pyarrow as pa

        take_memory("shingles", forget)
        for batch in batches:
            family = [int(g.min().astype(np.int64)) if len(g := in_order(words_of(x), 3)) else 0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(family, pa.int64())], names=[*batch.schema.names, "family"])

    marked = settle(sample.select("text", "toxic").mapInArrow(run, "text string, toxic int, family long"))
    sizes = marked.groupBy("family").agg((1 / F.count("*")).alias("weight"))
    return marked.join(sizes, "family").drop("family")


def mined(sample: DataFrame, toxic: float, other: float, most: int = PATTERNS) -> list[str]:
    """The patterns that separate best: smoothed log odds times the root of the toxic weight; ties by name.

    A beginning whose counts are those of a longer pattern says nothing more than that one and is left out.
    """
    odds = F.log((F.col("toxic") + 0.25) / (toxic + 0.5)) - F.log((F.col("other") + 0.25) / (other + 0.5))
    best = (
        _counted(sample)
        .filter("toxic >= 1.5")
        .withColumn("strength", odds * F.sqrt("toxic"))
        .filter(odds > 1.2)
        .orderBy(F.desc("strength"), "pattern")
        .limit(CANDIDATES)
        .collect()
    )
    longest: dict[tuple, str] = {}
    for r in sorted(best, key=lambda r: (len(r["pattern"].lstrip("=")), r["pattern"][0] == "="), reverse=True):
        bare = r["pattern"].lstrip("=")
        for k in STEMS:
            longest.setdefault((bare[:k], round(r["toxic"], 6), round(r["other"], 6)), r["pattern"])
    kept = [
        r["pattern"]
        for r in best
        if r["pattern"][0] == "=" or longest[r["pattern"], round(r["toxic"], 6), round(r["other"], 6)] == r["pattern"]
    ]
    return kept[:most]


class Features(dict):
    """Chunk -> positions of the patterns it shows."""

    def __init__(self, patterns: list[str]):
        super().__init__()
        self.place = {p: k for k, p in enumerate(patterns)}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = tuple(self.place[p] for p in patterns_of(chunk) if p in self.place)
        if len(self) > MEMO:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = found
        return found


def _vectors(sample: DataFrame, patterns: list[str]) -> DataFrame:
    """(doc_id, toxic, features array<double>, lexicon array<int>) of a bounded sample."""

    def run(batches):
        import pandas as pd

        take_memory("toxicity", lambda: None)
        known = Features(patterns)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = distinct_words(text)
                x = np.zeros(2 * len(patterns))
                for k, n in Counter(k for w in words for k in known[w]).items():
                    x[k], x[k + len(patterns)] = 1, n / len(words) ** 0.5
                bare = {w.strip(_EDGES) for w in words}
                out.append((x, np.array([int(v in bare) for v in LEXICON], dtype=np.int32)))
            yield pd.DataFrame({"toxic": pdf["toxic"], "features": [o[0] for o in out], "lexicon": [o[1] for o in out]})

    return sample.select("text", "toxic").mapInPandas(run, "toxic int, features array<double>, lexicon array<int>")


# ---------------------------------------------------------------- label model


@dataclass
class LabelModel:
    """Rates of firing of each voter on toxic and other documents, its share of a vote, and the share of toxic ones."""

    fires_toxic: np.ndarray
    fires_other: np.ndarray
    share: np.ndarray
    toxic: float
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _posterior(votes, self.fires_toxic, self.fires_other, self.share, self.toxic)


def _posterior(votes, p1, p0, share, toxic) -> np.ndarray:
    on, off = np.log(p1 / p0) * share, np.log((1 - p1) / (1 - p0)) * share
    logit = np.log(toxic / (1 - toxic)) + votes @ (on - off) + off.sum()
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, hand: bool = True, rounds: int = 12, close: float = 0.5) -> LabelModel:
    """Expectation maximisation on a 0/1 vote matrix from a first guess of the posteriors.

    Correlations are those of the votes after the two classes' means are taken out, weighted by the posteriors;
    voters correlated above ``close`` share a vote in proportion. With ``hand`` the last voter is a hand label: its
    rates are given (``HAND_RATES``), so that the classes keep their meaning.
    """
    q = np.clip(start.astype(float), 0.02, 0.98)
    share = np.ones(votes.shape[1])
    correlations = np.eye(votes.shape[1])
    p1 = p0 = share
    toxic = float(q.mean())
    for _ in range(rounds):
        toxic = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
        p1 = np.clip((q @ votes + 0.05) / (q.sum() + 1), 1e-4, 1 - 1e-4)
        p0 = np.clip(((1 - q) @ votes + 0.05) / ((1 - q).sum() + 1), 1e-4, 1 - 1e-4)
        if hand:
            p1[-1], p0[-1] = HAND_RATES
        rest1, rest0 = votes - p1, votes - p0
        covariance = (rest1.T * q) @ rest1 + (rest0.T * (1 - q)) @ rest0
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
        correlations = covariance / np.outer(spread, spread)
        share = 1 / np.where(correlations > close, correlations, 0).sum(axis=1).clip(1)
        if hand:
            share[-1] = 1.0
        q = _posterior(votes, p1, p0, share, toxic)
    return LabelModel(p1, p0, share, toxic, correlations)


# ---------------------------------------------------------------- model and scores


@dataclass
class Model:
    patterns: list[str]
    weights: list[float]
    bias: float


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic); held-out rows take no part."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
    )
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    drawn = usable if n <= sample_rows else usable.filter(draw < int((1 << 30) * sample_rows / n))
    sample = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(drawn, "doc_id"))
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not other:
        share = toxic / max(1, toxic + other)
        return Model([], [], float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    sample = settle(weighed(sample))
    weight = {r["toxic"]: r["w"] for r in sample.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    most = min(PATTERNS, int(2 * weight[1]))  # a few toxic rows can't tell many patterns from chance
    patterns = mined(sample, weight[1], weight[0], most)
    patterns += [p for p in ("=" + w for w in LEXICON) if p not in patterns]
    rows = settle(_vectors(sample, patterns))
    # votes of the bounded sample: a few bits per row
    voters = min(VOTERS, len(patterns))
    fired = rows.select("toxic", F.transform(F.slice("features", 1, max(1, voters)), lambda v: (v > 0).cast("tinyint")).alias("p"), "lexicon").toPandas()
    votes = np.array([[*p[:voters], *w, t] for p, w, t in zip(fired["p"], fired["lexicon"], fired["toxic"])], dtype=float)
    model = fit_label_model(votes, votes[:, -1])
    on, off = np.log(model.fires_toxic / model.fires_other) * model.share, np.log((1 - model.fires_toxic) / (1 - model.fires_other)) * model.share
    gain = F.array(*[F.lit(float(x)) for x in on - off])
    ballot = F.concat(
        F.transform(F.slice("features", 1, voters), lambda v: (v > 0).cast("double")) if voters else F.array().cast("array<double>"),
        F.col("lexicon").cast("array<double>"),
        F.array(F.col("toxic").cast("double")),
    )
    logit = F.lit(float(np.log(model.toxic / (1 - model.toxic)) + off.sum())) + F.aggregate(
        F.zip_with(ballot, gain, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
    )
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))
    scored = rows.select(array_to_vector("features").alias("features"), posterior.alias("q"))
    both = scored.select("features", F.lit(1.0).alias("label"), F.col("q").alias("weight")).unionByName(
        scored.select("features", F.lit(0.0).alias("label"), (1 - F.col("q")).alias("weight"))
    ).filter("weight > 1e-4")
    fitted = LogisticRegression(maxIter=60, regParam=REGULARISATION, weightCol="weight", standardization=False).fit(settle(both))
    return Model(patterns, [float(w) for w in fitted.coefficients], float(fitted.intercept))


def logits(texts: list[str | None], model: Model, known: Features) -> list[float]:
    half = len(model.patterns)
    out = []
    for text in texts:
        words = distinct_words(text)
        total = model.bias
        hits = Counter(k for found in map(known.__getitem__, words) if found for k in found)
        for k, n in hits.items():
            total += model.weights[k] + model.weights[k + half] * n / len(words) ** 0.5
        out.append(total)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of whole texts. The model has at most ``2 * PATTERNS`` weights; it is part of the tasks' closure."""

    def run(batches):
        import pyarrow as pa

        take_memory("toxicity", lambda: None)
        known = Features(model.patterns)
        for batch in batches:
            for part in rows_of(batch, 1024):
                z = np.array(logits(part.column(1).to_pylist(), model, known), dtype=float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``TOXIC_FROM``) of every row."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rows predicted toxic; scored beside the row, so no join moves texts."""
    model = fit(docs, labels)
    columns = docs.columns
    spot = columns.index("text")

    limit = float(np.log(TOXIC_FROM / (1 - TOXIC_FROM)))

    def run(batches):
        import pyarrow as pa

        take_memory("toxicity", lambda: None)
        known = Features(model.patterns)
        for batch in batches:
            for part in rows_of(batch, 1024):
                yield part.filter(pa.array([z < limit for z in logits(part.column(spot).to_pylist(), model, known)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
