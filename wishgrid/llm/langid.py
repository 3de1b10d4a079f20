"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wishgrid.llm.common import send_package

#: Hashed n-gram buckets, and the n.
BUCKETS, NGRAMS = 1 << 15, (1, 2, 3)
#: About this many labelled documents per language are used for fitting the weights; all count for the statistics.
FIT_PER_LANG = 600
#: Share of the fitted sample that is kept aside for the temperature.
CALIBRATION = 5
UNKNOWN = "und"
#: Below this score the filter lets a document go.
LEAST_SCORE = 0.3

#: What is no word character, and word characters that are no letters (digits, other numbers, the underscore).
_NOT_WORD = re.compile(r"[\W\d_]+")
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def buckets(text: str) -> np.ndarray | None:
    """Bucket of every character n-gram of the whole text (letters lower-cased, the rest one space); None: no letter."""
    letters = _NOT_WORD.sub(" ", text.lower())
    if not letters.isascii():  # number signs such as a half are word characters to a regular expression
        signs = {c for c in set(letters) if c != " " and not c.isalpha() and not unicodedata.category(c).startswith("M")}
        if signs:
            letters = " ".join(letters.translate(dict.fromkeys(map(ord, signs), " ")).split())
    letters = letters.strip()
    if not any(map(str.isalpha, letters)):
        return None
    chars = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    shift, found, value = np.uint64(64 - BUCKETS.bit_length() + 1), [], np.zeros(1, np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        head = value[: len(chars) - n + 1] if n > 1 else np.zeros(len(chars), np.uint64)
        if not len(head):
            break
        value = (head ^ (chars[n - 1 :] + np.uint64(n))) * _ODD[(n - 1) % 3]
        value = value ^ (value >> np.uint64(29))
        if n in NGRAMS:
            found.append((value * _ODD[0]) >> shift)
    return np.concatenate(found).astype(np.int64)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    at = None if text is None else buckets(text)
    if at is None:
        return None
    counts = np.bincount(at, minlength=BUCKETS)
    index = np.flatnonzero(counts)
    return index, counts[index]


def weighted(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with a damped term frequency, of length 1."""
    value = (1.0 + np.log(counts)) * idf[index]
    return value / np.sqrt((value * value).sum())


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Ftrl:
    """Follow-the-regularised-leader, proximal form, with L1 and L2 (elastic net), for several classes."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2e-4
    l2: float = 1e-4

    def __post_init__(self) -> None:
        self.z = np.zeros((BUCKETS, self.classes))
        self.n = np.zeros((BUCKETS, self.classes))

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = softmax(value @ w)
        p[label] -= 1.0
        g = value[:, None] * p
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] += g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by a golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = term_counts(text) if self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax(weighted(*found, self.idf) @ self.weights[found[0]] / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = FIT_PER_LANG, epochs: int = 3) -> Model:
    """documents(doc_id, text, lang) -> Model, from documents with an id, a lang and a text that are not held out.

    How many of them hold an n-gram (for the inverse document frequency) is counted over all of them, in tasks that
    send one sparse vector each. The weights are fitted on about ``per_lang`` documents a language, chosen by hash of
    id and text, equal rows once: a bound that does not grow with the input. Without any labelled document the model knows no language.
    """
    send_package(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs_seen = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = buckets(text)
                if at is not None:
                    mark = np.zeros(BUCKETS, bool)
                    mark[at] = True
                    seen += mark
                    docs_seen += 1
        index = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(index, -1)), pa.array(np.append(seen[index], docs_seen))], ["bucket", "n"])

    frequency = labelled.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    idf, total = np.zeros(BUCKETS), 0
    for row in frequency.collect():  # one row per bucket
        if row.bucket < 0:
            total = row.n
        else:
            idf[row.bucket] = row.n
    idf = np.log((1.0 + total) / (1.0 + idf)) + 1.0
    by_lang = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(by_lang)
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(7)), F.lit(1 << 52))
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(max(1, round(per_lang / n * (1 << 52))))) for k, n in by_lang.items()))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = term_counts(text)
                if found is not None:
                    rows.append((place, lang, found[0].astype(np.int32).tobytes(), found[1].astype(np.int32).tobytes()))
            yield pa.record_batch(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary()))],
                ["place", "lang", "index", "counts"],
            )

    # rows equal in id, text and lang share a place: they are fitted once, however often they stand
    chosen = labelled.where(place < share).select(place.alias("place"), "lang", "text")
    sample = chosen.mapInArrow(vectors, "place long, lang string, index binary, counts binary").distinct()
    rows = sorted(tuple(r) for r in sample.collect())  # bounded by per_lang a language
    data = []
    for _, lang, index, counts in rows:
        at = np.frombuffer(index, np.int32)
        data.append((at, weighted(at, np.frombuffer(counts, np.int32), idf), langs.index(lang)))
    aside = data[::CALIBRATION]
    train = [d for k, d in enumerate(data) if k % CALIBRATION]
    learner, order = Ftrl(len(langs)), np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(train)):
            learner.learn(*train[k])
    weights = learner.weights()
    logits = np.array([v @ weights[i] for i, v, _ in aside]).reshape(len(aside), len(langs))
    return Model(langs, idf, weights, temperature(logits, np.array([y for _, _, y in aside], int)))


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs``, with the language of its whole ``text`` and a calibrated score from 0 to 1.

    A null text, or one without a letter, or a model without languages gives ``und`` and 0. A column of ``docs`` with
    the name of a new one is replaced. Row by row in Arrow batches: no shuffle; repeated rows stay.
    """
    docs = docs.drop(lang, score)
    send_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    at = docs.columns.index("text")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sent.value
        for batch in batches:
            found = [told.predict(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, lang, score])

    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(predicted, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """Documents (all their columns) whose language is told with a score of at least ``least``."""
    names = ["_lang_pred", "_lang_score"]
    return identify(docs, model, *names).where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).drop(*names)
