"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of words with their ends marked, hashed to ``BUCKETS``
numbers; a text has a feature or not.  With n1, n0 the toxic and other training texts that
have feature f, its ratio is r = log(((n1 + a) / (N1 + 2a)) / ((n0 + a) / (N0 + 2a))).  A
logistic regression is fitted on the features times r; the product of weight and r is what a
text that has the feature adds to its log-odds.  The features kept are the ``KEPT`` with the
strongest difference between the classes.

Training takes at most ``SAMPLE`` labelled rows, those with the smallest hash of their id, and
counts equal texts once.  Scoring covers every row in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import Memo, let_go, stage, text_or_empty

SAMPLE = 20_000
BUCKETS = 1 << 18
KEPT = 2_048
SIZES = (3, 4, 5, 6)
SMOOTHING = 1.0
PENALTY = 1.0
STEPS = 200
CUT = 0.3
REMEMBERED = 200_000
TEXTS = 256  # taken at once


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_features(word: str) -> list[int]:
    """Hashed n-grams of a lower-cased word with marked ends."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in SIZES for i in range(max(1, len(marked) - n + 1))}
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


def words(text: str) -> set[str]:
    """Different words of a text: runs of non-blank characters without the punctuation around
    them."""
    return {w.strip(_EDGES) for w in text.lower().split()}


_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


@dataclass(frozen=True)
class Model:
    """Kept feature numbers (ascending), what each adds to the log-odds, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self):
        """Function from texts to scores, with a bounded memo of words."""
        place = dict(zip(self.features.tolist(), range(len(self.features)), strict=True))

        def kept(many: list[str]) -> Iterator[tuple[int, ...]]:
            for word in many:
                yield tuple(place[f] for f in word_features(word) if f in place)

        memo, none = Memo(kept, REMEMBERED), frozenset()

        def score(texts: list[str]) -> np.ndarray:
            sums = np.full(len(texts), self.intercept)
            for i, text in enumerate(texts):
                own = words(text)
                memo.learn(own)
                found = none.union(*map(memo.__getitem__, own))
                if found:
                    sums[i] += self.weights[sorted(found)].sum()
            return 1.0 / (1.0 + np.exp(-np.clip(sums, -40, 40)))

        return score


def training_rows(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """``text, label`` of the training sample, equal texts once (toxic if one of them is).

    Labels that are null, held-out rows and ids without a text are left out; an id with
    several labels is toxic if one is.  The labels sent to all tasks are ``sample`` rows at
    most.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("known_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("known_id"), "known_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("known_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.join(F.broadcast(known), "known_id").groupBy("text").agg(F.max("label").alias("label"))


def _feature_rows(batches: Iterator[pa.RecordBatch], keep: np.ndarray | None) -> Iterator[tuple[np.ndarray, list]]:
    """Labels and features (ascending) of a few texts at a time: a text has thousands of features."""
    let_go()
    memo = Memo(lambda many: (np.array(word_features(word), np.int32) for word in many), REMEMBERED // 4)
    seen = np.zeros(BUCKETS, bool)
    for part in (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS)):
        out = []
        for text in part.column("text").to_pylist():
            own = words(text)
            memo.learn(own)
            for features in map(memo.__getitem__, own):
                seen[features] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            if keep is not None:
                at = np.minimum(np.searchsorted(keep, found), len(keep) - 1)
                found = at[keep[at] == found]
            out.append(found)
        yield np.array(part.column("label").to_pylist(), np.int64), out


def feature_counts(rows: DataFrame) -> DataFrame:
    """``feature, toxic, other``: texts of each class that have the feature; feature -1 counts
    the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        texts = np.zeros(2, np.int64)
        for label, found in _feature_rows(batches, None):
            for y, features in zip(label, found, strict=True):
                counts[1 - y, features] += 1
                texts[1 - y] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([[-1], seen]), pa.int64()),
                pa.array(np.concatenate([texts[:1], counts[0, seen]]), pa.int64()),
                pa.array(np.concatenate([texts[1:], counts[1, seen]]), pa.int64()),
            ],
            names=["feature", "toxic", "other"],
        )

    each = rows.mapInArrow(work, "feature long, toxic long, other long")
    return each.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic regression on 0/1 features times
    ``scale``; accelerated gradient steps with a safe step size."""
    n, m = len(y), len(scale)
    column = np.concatenate(rows) if n else np.empty(0, np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    weight, bias = np.zeros(m), 0.0
    # The largest eigenvalue of X'X, by power iteration, bounds the curvature.
    probe = np.ones(m) / max(1.0, np.sqrt(m))
    bound = 1.0
    for _ in range(12):
        image = np.bincount(row, (probe * scale)[column], n)
        probe = scale * np.bincount(column, image[row], m)
        bound = float(np.linalg.norm(probe)) or 1.0
        probe /= bound
    step = 1.0 / (0.25 * (1.2 * bound + n) + PENALTY)
    ahead, ahead_bias, momentum = weight.copy(), bias, 1.0
    for _ in range(STEPS):
        odds = np.bincount(row, (ahead * scale)[column], n) + ahead_bias
        miss = 1.0 / (1.0 + np.exp(-np.clip(odds, -40, 40))) - y
        new = ahead - step * (scale * np.bincount(column, miss[row], m) + PENALTY * ahead)
        new_bias = ahead_bias - step * miss.sum()
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / nxt * (new - weight)
        ahead_bias = new_bias + (momentum - 1) / nxt * (new_bias - bias)
        weight, bias, momentum = new, new_bias, nxt
    return weight, bias


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **columns: str) -> Model:
    """Fit on at most ``sample`` labelled rows.  Without rows of both classes the model has no
    features, and its score is the smoothed share of toxic rows (0.05 without any)."""
    rows = stage(training_rows(docs, labels, sample, **columns), "training")
    counts = {r["feature"]: (r["toxic"], r["other"]) for r in feature_counts(rows).collect()}  # BUCKETS rows at most
    toxic, other = counts.pop(-1, (0, 0))
    prior = (toxic + 0.05) / (toxic + other + 1.0)
    nothing = Model(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))
    if not toxic or not other or not counts:
        return nothing
    feature = np.array(sorted(counts), np.int64)
    n1, n0 = np.array([counts[f] for f in feature.tolist()], float).T
    share = (n1 + n0) / (toxic + other)
    spread = np.sqrt(share * (1 - share) * (1 / toxic + 1 / other)) + 1e-9
    strength = np.abs(n1 / toxic - n0 / other) / spread
    best = np.sort(np.lexsort((feature, -strength))[:KEPT])
    keep = feature[best]
    ratio = np.log((n1[best] + SMOOTHING) / (toxic + 2 * SMOOTHING)) - np.log(
        (n0[best] + SMOOTHING) / (other + 2 * SMOOTHING)
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, found in _feature_rows(batches, keep):
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array([f.astype("<u2").tobytes() for f in found], pa.binary())],
                names=["label", "features"],
            )

    fitted = rows.mapInArrow(work, "label int, features binary").toPandas()  # `sample` rows at most
    found = [np.frombuffer(f, "<u2").astype(np.int64) for f in fitted["features"]]
    weight, bias = fit_logistic(found, fitted["label"].to_numpy(float), ratio)
    return Model(keep, weight * ratio, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` with ``out`` (0 to 1) added; a null text counts as empty, a very
    long one is scored whole.

    A column of that name is replaced.  Repeated rows get equal scores; no rows give no rows.
    """
    names = [c for c in docs.columns if c != out]
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.intercept))

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        scorer = Model(*shared.value).scorer()
        for batch in batches:
            parts = [scorer(batch.slice(at, TEXTS).to_pylist()) for at in range(0, len(batch), TEXTS)]
            yield pa.array(np.concatenate([np.empty(0), *parts]), pa.float64())

    return docs.select(*names, rate(text_or_empty(text_col)).alias(out))
