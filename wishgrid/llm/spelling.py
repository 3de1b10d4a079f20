"""Spelling variants: words one edit apart, found by bit-sliced position indexes, follow the more frequent form."""

from __future__ import annotations

import collections
import itertools
import math
import operator
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wishgrid.llm.common import send_package, written

#: Words have at least this many code points and occurrences; a form is at least this many times as frequent.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many of a document loses a code point.
DAMAGE = 199
#: About this many words share one bit-sliced index; larger blocks are cut.
CELL = 32_768
#: Distinct words that one task counts before it sends them on.
COUNTED = 500_000

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_GROUP = operator.methodcaller("group")


def run_counts(doc_id: str, text: bytes, least: int = LEAST_LENGTH, damage: int = DAMAGE) -> Iterator[tuple[str, int]]:
    """Words of a whole UTF-8 text with their counts; only A to Z are lower-cased.

    The crc32 of ``doc_id:run`` decides which runs lose a code point, and which one; then what is too short goes.
    """
    prefix = zlib.crc32(f"{doc_id}:".encode())
    for run, n in collections.Counter(map(_GROUP, _RUN.finditer(text.lower()))).items():
        if len(run) < least:
            continue
        word, h = run.decode(), zlib.crc32(run, prefix)
        if h % damage == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            yield word, n


def word_counts(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """documents(doc_id, text) -> word, n: distinct words with their occurrences over all documents.

    Each task counts its documents before anything is shuffled. A null text has no words; a null id is written as
    nothing before the colon; repeated rows count each; no rows give no rows.
    """
    send_package(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def table() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word, n in run_counts(doc_id, text):
                    total[word] = total.get(word, 0) + n
                if len(total) > COUNTED:
                    yield table()
                    total.clear()
        yield table()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    words = texts.where(F.col("text").isNotNull()).mapInArrow(counted, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _marks(values: Iterable) -> dict:
    """Value -> the places that have it, as the bits of a number (nothing for the value None)."""
    values = list(values)
    room, marks = (len(values) + 7) // 8, {}
    for i, value in enumerate(values):
        if value is not None:
            bits = marks.get(value)
            if bits is None:
                bits = marks[value] = bytearray(room)
            bits[i >> 3] |= 1 << (i & 7)
    return {value: int.from_bytes(bits, "little") for value, bits in marks.items()}


def _positions(words: list[str], start: int) -> list[dict[str, int]]:
    """For each position from ``start`` on: letter -> the words that have it there."""
    return [_marks(column) for column in itertools.zip_longest(*(w[start:] for w in words))]


class Cell:
    """Words of one block (most frequent first) under a bit-sliced position index.

    All words of a block are ``shorter`` or one more code points long and agree in the first ``start`` of them; the
    words of a suffix block are held reversed. Near words of which the shorter has ``shorter`` code points are found:
    pairs that agree in the first half in the prefix block, all others in the suffix block, so none twice.
    """

    def __init__(self, words: list[str], shorter: int, suffix: bool) -> None:
        self.shorter, self.suffix, self.half = shorter, suffix, (shorter + 1) // 2
        self.start = shorter - self.half if suffix else self.half
        own = [w[::-1] for w in words] if suffix else words
        self.at = _positions(own, self.start) + [{}, {}]
        self.all = (1 << len(words)) - 1
        self.long = _marks(len(w) > shorter for w in words).get(True, 0)
        self.heads = _marks(w[: self.half] for w in words) if suffix else {}

    def near(self, word: str) -> int:
        """The words at one edit, as bits.

        ``same`` holds the words without an error up to here, ``changed``, ``longer`` and ``fewer`` those with one: a
        replaced letter, one more letter in the word of the index (its letters stand one place later), one letter of
        ``word`` left out (one place earlier).
        """
        letters = (word[::-1] if self.suffix else word)[self.start :]
        at, same = self.at, self.all
        if len(word) == self.shorter:
            changed = longer = 0
            for p, letter in enumerate(letters):
                here = at[p].get(letter, 0)
                longer = (longer | same) & at[p + 1].get(letter, 0)
                hit = same & here
                changed = (changed & here) | (same ^ hit)
                same = hit
                if not (same or changed or longer):
                    return 0
            found = (changed & ~self.long) | ((longer | same) & self.long)
        else:
            fewer = 0
            for p, letter in enumerate(letters):
                fewer = (fewer & at[p - 1].get(letter, 0) if p else 0) | same
                same &= at[p].get(letter, 0)
                if not (same or fewer):
                    return 0
            found = fewer & ~self.long
        return found & ~self.heads.get(word[: self.half], 0) if self.suffix else found


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """word, n (distinct words) -> word, n_near, best (struct of -n and word of the best near word); none: no row.

    Two words one edit apart agree in the first or in the last half of the shorter one's code points. So a word goes to
    the blocks of its halves, once for each length the shorter one may have. A block of more than ``cell`` words is cut
    into squares of words against words; each square is one index in one task, and what comes back is a count and the
    best word for each word, so neither pairs nor large blocks are gathered.
    """
    send_package(words.sparkSession)
    size = F.char_length("word")
    shorter = F.filter(F.array(size - 1, size), lambda m: m >= LEAST_LENGTH)
    keys = F.flatten(
        F.transform(
            shorter,
            lambda m: F.array(
                F.struct(m.alias("shorter"), F.lit(False).alias("suffix"), F.substring(F.col("word"), F.lit(1), F.ceil(m / 2).cast("int")).alias("piece")),
                F.struct(m.alias("shorter"), F.lit(True).alias("suffix"), F.substring(F.col("word"), size - F.floor(m / 2).cast("int") + 1, F.floor(m / 2).cast("int")).alias("piece")),
            ),
        )
    )
    names = ["shorter", "suffix", "piece"]
    blocks = words.select("word", "n", F.explode(keys).alias("k")).select("k.*", "word", "n")
    large = written(blocks.groupBy(*names).agg(F.count("*").alias("size")).where(F.col("size") > cell), "spelling-blocks")
    told = blocks.join(large, names, "left").withColumn("parts", F.coalesce(F.expr(f"(size + {cell - 1}) div {cell}"), F.lit(1)))
    own, other = F.pmod(F.xxhash64("word"), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)

    def place(asks: bool, asked: bool, ask: Column, answer: Column) -> Column:
        return F.struct(ask.alias("ask"), answer.alias("answer"), F.lit(asked).alias("asked"), F.lit(asks).alias("asks"))

    places = F.when(F.col("parts") == 1, F.array(place(True, True, own, own))).otherwise(
        F.concat(F.transform(other, lambda o: place(False, True, o, own)), F.transform(other, lambda o: place(True, False, own, o)))
    )
    cells = [*names, "ask", "answer"]
    spread = told.select(*names, "word", "n", F.explode(places).alias("p")).select(*names, "p.*", "word", "n")
    sorted_ = spread.repartition(*cells).sortWithinPartitions(*cells, F.desc("asked"), F.desc("n"), "word")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, str]] = []
        for (shorter, suffix, *_), group in itertools.groupby(rows(batches), operator.itemgetter(0, 1, 2, 3, 4)):
            words, counts, waiting = [], [], []
            for *_, asked, asks, word, n in group:  # those that are asked come first
                if asked:
                    words.append(word)
                    counts.append(n)
                if asks:
                    waiting.append(word)
            if len(words) < 2 and waiting == words:
                continue
            index = Cell(words, shorter, suffix) if words else None
            for word in waiting if index else ():
                found = index.near(word)
                if found:
                    best = (found & -found).bit_length() - 1
                    out.append((word, found.bit_count(), counts[best], words[best]))
            if len(out) > 10_000:
                yield _found(out)
                out = []
        yield _found(out)

    found = sorted_.mapInArrow(searched, "word string, near long, best_n long, best string")
    best = F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(best).alias("best"))


def _found(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["word", "near", "best_n", "best"])


def spelling_variants(docs: DataFrame, times: int = TIMES, cell: int = CELL) -> DataFrame:
    """documents(doc_id, text) -> word, n, n_near, form, form_n, root; one row per word of the vocabulary.

    The form of a word is its near word of largest n (ties: least in code point order) if that is at least ``times``
    as frequent; the root is where the forms lead. Each step multiplies the count, so the number of steps is at most a
    logarithm of the largest count, and pointers that double their reach find all roots in a logarithm of that.
    """
    words = written(word_counts(docs), "spelling-words")
    near = near_words(words, cell)
    is_form = -F.col("best.minus_n") >= F.col("n") * times
    told = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"),
        F.when(is_form, -F.col("best.minus_n")).alias("form_n"),
    )
    told = written(told, "spelling-forms")
    links = told.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    largest = words.agg(F.max("n").alias("n")).first().n or 1
    reach, steps = 1, int(math.log(largest) / math.log(times)) + 1
    while reach < steps:
        links = written(links, "spelling-links")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        reach *= 2
    return told.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
