"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wishgrid.llm.common import send_package

#: Hashed features; the bias has a place of its own behind them.
BUCKETS = 1 << 20
#: Words longer than these also count by their first letters, so that inflected forms share a feature.
STEMS = (4, 5, 6)
#: At most about this many labelled documents of each label are used for fitting.
FIT_PER_LABEL = 3000
#: Parts of them that take turns in being left out for the calibration.
FOLDS = 4
#: Words whose hashes one task remembers.
REMEMBERED = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
#: Kinds of features: the word, two neighbours, two words with one between them, then the stems.
_WORDS, _PAIRS, _SKIPS, _STEM = (np.uint64(k << 40) for k in (1, 2, 3, 4))


class _Hashes(dict):
    """Word -> row of hashes (the word itself, then its stems; 0: none). Forgets all when full."""

    def __init__(self, room: int = REMEMBERED) -> None:
        super().__init__()
        self.rows = np.zeros((room, 1 + len(STEMS)), np.uint64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.rows[at, 0] = zlib.crc32(word.encode()) + 1
        for k, n in enumerate(STEMS, 1):
            self.rows[at, k] = zlib.crc32(word[:n].encode()) + 1 if len(word) > n else 0
        return at

    def of(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if len(self) + len(words) > len(self.rows):
            self.clear()
            if len(words) > len(self.rows):
                self.rows = np.zeros((len(words), 1 + len(STEMS)), np.uint64)
        return self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of every feature of a text, as often as it occurs."""
    word = hashes[:, 0]
    parts = [word + _WORDS, word[:-1] * _ODD[1] ^ (word[1:] + _PAIRS), word[:-2] * _ODD[1] ^ (word[2:] + _SKIPS)]
    for k in range(1, hashes.shape[1]):
        stem = hashes[:, k]
        parts.append(stem[stem > 0] + _STEM * np.uint64(k))
    return ((np.concatenate(parts) * _ODD[0]) >> _SHIFT).astype(np.int64)


def damped(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets with 1 + ln of their counts."""
    index, counts = np.unique(found, return_counts=True)
    return index, 1.0 + np.log(counts)


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(max(x, -35.0), 35.0)))


class Ftrl:
    """Follow-the-regularised-leader, proximal form: a rate per coordinate, L1 for sparse weights; the bias has no L1."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, l1 = self.z[index], np.where(index == BUCKETS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (sigmoid(float(w @ value)) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] += g * g


def calibration(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the logits kept aside likeliest (Newton's method; both labels needed)."""
    slope, offset = 1.0, 0.0
    if len(set(labels.tolist())) < 2:
        return slope, offset
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * logits + offset, -35, 35)))
        w = p * (1 - p) + 1e-6
        gradient = np.array([((p - labels) * logits).sum() + 0.01 * (slope - 1), (p - labels).sum()])
        cross = (w * logits).sum()
        step = np.linalg.solve(np.array([[(w * logits * logits).sum() + 0.01, cross], [cross, w.sum()]]), gradient)
        slope, offset = slope - step[0], offset - step[1]
    return (float(slope), float(offset)) if np.isfinite(slope + offset) and slope > 0 else (1.0, 0.0)


def fitted(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4) -> np.ndarray:
    """Weights of all buckets and the bias."""
    learner, order = Ftrl(), np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            learner.learn(*examples[k])
    return learner.weights(np.arange(BUCKETS + 1))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with a weight, and the weights; the bias stands at BUCKETS.

    The weights come from all examples. They are calibrated on logits that each example gets from weights learned
    without its fold, and the calibration is worked into them.
    """
    own = [(np.append(i, BUCKETS), np.append(v, 1.0), y) for i, v, y in examples]
    logits = np.zeros(len(own))
    for fold in range(FOLDS):
        apart = fitted([e for k, e in enumerate(own) if k % FOLDS != fold])
        for k in range(fold, len(own), FOLDS):
            logits[k] = apart[own[k][0]] @ own[k][1]
    slope, offset = calibration(logits, np.array([y for *_, y in own], float))
    every = fitted(own) * slope
    every[BUCKETS] += offset
    index = np.union1d(np.flatnonzero(every), [BUCKETS])
    return index, every[index]


@dataclass
class Model:
    """Sparse weights by bucket; without any labelled document every score is 0."""

    index: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self._all: np.ndarray | None = None
        self._hashes: _Hashes | None = None

    def __getstate__(self) -> tuple:
        return self.index, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.index, self.weights = state
        self.__post_init__()

    def score(self, text: str | None) -> float:
        if not len(self.index):
            return 0.0
        if self._all is None:
            self._all, self._hashes = np.zeros(BUCKETS + 1), _Hashes()
            self._all[self.index] = self.weights
        found = buckets(self._hashes.of(text or ""))
        index, value = damped(found[self._all[found] != 0])
        return sigmoid(float(self._all[index] @ value + self._all[BUCKETS]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = FIT_PER_LABEL) -> Model:
    """documents(doc_id, text), labels(doc_id, toxic) -> Model, from labels 0 and 1 of documents that are not held out.

    Null ids and labels and labels without a document teach nothing; documents that give the same features with the
    same label count once; a document with both labels teaches both. About ``per_label`` labelled ids of each label are
    used, chosen by hash of the id: a bound that does not grow with the input, so the chosen ids can be broadcast to
    the scan of the documents and one task can learn from their features. The rates at which the labels were chosen are
    set off in the bias. What comes back is one row per weight that L1 has left.
    """
    spark = docs.sparkSession
    send_package(spark)
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .distinct()
    )
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not n:
        return Model(np.zeros(0, np.int64), np.zeros(0))
    share = {k: min(1.0, per_label / v) for k, v in n.items()}
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(13)), F.lit(1 << 52))
    chosen = known.withColumn("place", place).where(
        place < F.coalesce(*(F.when(F.col("label") == k, F.lit(s * (1 << 52))) for k, s in share.items()))
    )
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            rows = []
            for place, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, value = damped(buckets(hashes.of(text or "")))
                rows.append((place, label, index.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["place", "label", "index", "value"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        examples = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), y) for _, y, i, v in rows]
        if examples:
            index, weights = train(examples)
            yield pa.record_batch([pa.array(index), pa.array(weights)], ["bucket", "weight"])

    vectors = taught.select("place", "label", "text").mapInArrow(features, "place long, label int, index binary, value binary")
    once = vectors.groupBy("label", "index", "value").agg(F.min("place").alias("place")).select("place", "label", "index", "value")
    weights = once.repartition(1).mapInArrow(learned, "bucket long, weight double").collect()  # at most one row per bucket
    index, values = np.array([r.bucket for r in weights], np.int64), np.array([r.weight for r in weights])
    if len(n) == 2 and len(values):
        values[index == BUCKETS] += math.log(share[0] / share[1])
    return Model(index, values)


def toxicity(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """All columns of ``docs``, with the probability that its whole ``text`` is toxic.

    A null text scores like an empty one: by the bias. A column of ``docs`` with the name of the new one is replaced.
    Row by row in Arrow batches: no shuffle; repeated rows stay; no rows give no rows. A very long text takes about 60
    bytes a word while it is scored.
    """
    docs = docs.drop(score)
    send_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # what L1 has left of BUCKETS weights
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sent.value
        for batch in batches:
            new = pa.array([told.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, score])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(score, DoubleType())]))
