"""Column helpers for text: normalisation and similarity.

Everything stays in built-in expressions, but for ``pair_similarity``: many candidate pairs are compared in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Lower-case letters that look alike, and the letter folded to its base form.
LOOKALIKE_FROM = "ёabcehkmoptxy"
LOOKALIKE_TO = "еавсенкмортху"
MARK = "\x01"  # reserved inside span expressions

U = "(?U)"  # Unicode classes for \w, \b, \s, \d


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_chars(c: Column | str) -> Column:
    """Lower-case, fold look-alike letters; the length never changes, so offsets stay valid."""
    text = col(c)
    by_char = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda ch: F.when(F.length(F.lower(ch)) == F.length(ch), F.lower(ch)).otherwise(ch),
        ),
        "",
    )
    safe = let(F.lower(text), lambda low: F.when(F.length(low) == F.length(text), low).otherwise(by_char))
    return F.translate(safe, LOOKALIKE_FROM + MARK, LOOKALIKE_TO + " ")


def normalize_key(c: Column | str) -> Column:
    """Matching key: case-folded, look-alikes folded, white space collapsed and trimmed."""
    folded = F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))
    mapped = F.translate(folded, LOOKALIKE_FROM, LOOKALIKE_TO)
    return F.trim(F.regexp_replace(mapped, U + r"[\s\x1c-\x1f]+", " "))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain expression used inside a lambda is evaluated again for every element; bound here it
    is a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- F2: similarity -------------------------------------------------------------------------

MASK_BITS = 61  # longest text whose positions fit a BIGINT without overflow in the sum below


def char_masks(text: Column) -> Column:
    """``map<char, bit mask of its positions>`` for texts of at most ``MASK_BITS`` characters."""
    def masks_of(positions: Column) -> Column:
        distinct = F.array_distinct(F.transform(positions, lambda p: p["c"]))
        bits = F.transform(
            distinct,
            lambda c: F.aggregate(
                F.filter(positions, lambda p: p["c"] == c),
                F.lit(0).cast("long"),
                lambda acc, p: acc.bitwiseOR(
                    F.call_function("shiftleft", F.lit(1).cast("long"), p["i"])
                ),
            ),
        )
        return F.map_from_arrays(distinct, bits)

    chars = F.split(text, "")
    return let(F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), masks_of)


def _lcs_bits(masks: Column, length: Column, other: Column) -> Column:
    """Bit-parallel longest common subsequence (Crochemore et al. 2001, Hyyrö 2004)."""
    one = F.lit(1).cast("long")
    full = F.call_function("shiftleft", one, length) - one
    init = F.struct(full.alias("v"), full.alias("full"), masks.alias("m"))

    def step(acc: Column, c: Column) -> Column:
        v = acc["v"]
        u = v.bitwiseAND(F.coalesce(acc["m"][c], F.lit(0).cast("long")))
        nxt = (v + u).bitwiseOR(v - u).bitwiseAND(acc["full"])
        return F.struct(nxt.alias("v"), acc["full"].alias("full"), acc["m"].alias("m"))

    return length - F.aggregate(F.split(other, ""), init, step, lambda acc: F.bit_count(acc["v"]))


def _lcs_rows(a: Column, b: Column) -> Column:
    """Row-by-row dynamic programme for texts too long for one BIGINT."""

    def fold(b_chars: Column) -> Column:
        def row_step(row: Column, ca: Column) -> Column:
            size = F.size(row) - 1
            zipped = F.arrays_zip(
                F.slice(b_chars, F.lit(1), size),
                F.slice(row, F.lit(1), size),
                F.slice(row, F.lit(2), size),
            )
            return F.aggregate(
                zipped,
                F.array(F.lit(0)),
                lambda out, z: F.array_append(
                    out,
                    F.greatest(
                        F.element_at(out, -1),
                        z["2"],
                        F.when(z["0"] == ca, z["1"] + 1).otherwise(F.lit(0)),
                    ),
                ),
            )

        zero = F.array_repeat(F.lit(0), F.size(b_chars) + 1)
        return F.aggregate(F.split(a, ""), zero, row_step, lambda row: F.element_at(row, -1))

    return let(F.split(b, ""), fold)


def lcs_length(a: Column, b: Column, masks: Column | None = None) -> Column:
    masks = char_masks(a) if masks is None else masks
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0))
        .when(F.length(a) <= MASK_BITS, _lcs_bits(masks, F.length(a), b).cast("int"))
        .otherwise(_lcs_rows(a, b))
    )


def similarity(a: Column, b: Column, masks: Column | None = None) -> Column:
    """normalised insertion/deletion ratio in 0..100; two empty texts give 0."""
    total = F.length(a) + F.length(b)
    ratio = F.lit(200.0) * lcs_length(a, b, masks) / total
    return F.when(a == b, F.when(total > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(ratio)


BATCH_BITS = 64  # longest text whose positions fit the words of a batch
BATCH_PAIRS = 8192


def _lcs_pairs(a: Column, b: Column) -> Column:
    """``lcs_length`` in Arrow batches. All helpers are inner ones, so executors need no module of ours.

    Called nondeterministic, so that a filter on the score does not work it out twice.
    """

    def codes(texts: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
        """Code points (a row per text, longer ones left blank) and lengths; equal texts are read once."""
        distinct = texts.dictionary_encode()
        found = distinct.dictionary.to_pylist()
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        short = np.where(lengths <= BATCH_BITS, lengths, 0)
        wide = -(-int(short.max(initial=1)) // 8) * 8
        points = np.full((len(found), wide), pad, dtype=np.uint32)
        joined = "".join(t for t in found if len(t) <= BATCH_BITS).encode("utf-32-le", "surrogatepass")
        points[np.arange(wide) < short[:, None]] = np.frombuffer(joined, dtype="<u4")
        at = distinct.indices.to_numpy(zero_copy_only=False)
        return points[at], lengths[at]

    def batch(x: np.ndarray, lx: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The recurrence of ``_lcs_bits`` for many pairs at once; what overflows a word is beyond its positions."""
        shift = (BATCH_BITS - np.maximum(lx, 1)).astype(np.uint64)
        full = np.where(lx > 0, np.uint64(2**64 - 1) >> shift, np.uint64(0))
        v = full.copy()
        masks = np.zeros((len(lx), BATCH_BITS // 8), dtype=np.uint8)
        for j in range(y.shape[1]):
            masks[:, : x.shape[1] // 8] = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little")
            u = v & masks.view("<u8")[:, 0]
            v = ((v + u) | (v - u)) & full
        return lx - np.bitwise_count(v).astype(np.int64)

    def single(x: str, y: str) -> int:
        masks: dict[str, int] = {}
        for i, c in enumerate(x):
            masks[c] = masks.get(c, 0) | 1 << i
        full = v = (1 << len(x)) - 1
        for c in y:
            u = v & masks.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return len(x) - v.bit_count()

    def lcs(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), dtype=np.int32)
        for start in range(0, len(left), BATCH_PAIRS):
            part, other = left.slice(start, BATCH_PAIRS), right.slice(start, BATCH_PAIRS)
            (x, lx), (y, ly) = codes(part, 0), codes(other, 2**32 - 1)
            long = (lx > BATCH_BITS) | (ly > BATCH_BITS)
            fits = np.flatnonzero(~long)
            out[start + fits] = batch(x[fits], lx[fits], y[fits]) if len(fits) < len(long) else batch(x, lx, y)
            for i in np.flatnonzero(long).tolist():
                out[start + i] = single(part[i].as_py(), other[i].as_py())
        return pa.array(out)

    return F.arrow_udf(lcs, IntegerType()).asNondeterministic()(a, b)


def pair_similarity(a: Column, b: Column) -> Column:
    """``similarity`` for tables of candidate pairs, neither text null."""
    total = F.length(a) + F.length(b)
    ratio = F.lit(200.0) * _lcs_pairs(a, b) / total
    return F.when(a == b, F.when(total > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(ratio)


def token_sort(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


# --- scores of names that contain each other ----------------------------------------------------

#: Weights of the composite score, and the ratios of lengths at which they change.
SORTED_WEIGHT = 0.95
PARTIAL_FROM, PARTIAL_WEIGHT = 1.5, 0.9
FAR_FROM, FAR_WEIGHT = 8.0, 0.6


def pieces(short: Column, long: Column) -> Column:
    """All pieces of the longer text that are as long as the shorter one, or that its ends cut."""
    n, m = F.length(short), F.length(long)
    found = F.transform(
        F.sequence(2 - n, m),
        lambda at: F.substring(long, F.greatest(at, F.lit(1)), F.least(at + n - 1, m) - F.greatest(at, F.lit(1)) + 1),
    )
    return F.when((n > 0) & (m > 0), F.array_distinct(found)).otherwise(F.array())


def best_ratios(asked: Column) -> Column:
    """Best F2 per item of an array of ``struct<x, ys>``; one expression for all of them keeps plans small."""
    return F.transform(
        asked,
        lambda q: F.coalesce(
            let(F.struct(q["x"].alias("x"), q["ys"].alias("ys"), char_masks(q["x"]).alias("k")), lambda p: F.array_max(F.transform(p["ys"], lambda y: similarity(p["x"], y, p["k"])))),
            F.lit(0.0),
        ),
    )


def token_sets(a: Column, b: Column) -> Column:
    """``struct<both, a, b>``: shared words and the rest of each side, each sorted and joined by spaces."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))

    def joined(words: Column) -> Column:
        return F.array_join(F.array_sort(words), " ")

    return F.struct(
        joined(F.array_intersect(x, y)).alias("both"), joined(F.array_except(x, y)).alias("a"), joined(F.array_except(y, x)).alias("b")
    )


def token_set_ratio(sets: Column, ratio: Column) -> Column:
    """F2 of the shared words against the shared words with either rest, whichever is best; 100 if one side is all shared.

    ``ratio`` is F2 of the two rests.
    """
    both, a, b = (F.length(sets[k]) for k in ("both", "a", "b"))
    gap = F.when(both > 0, F.lit(1)).otherwise(F.lit(0))
    whole = (F.lit(200.0) * (both + gap) + ratio * (a + b)) / (2 * (both + gap) + a + b)
    alone = F.lit(200.0) * both / (2 * both + 1 + F.least(a, b))
    return F.when((both > 0) & ((a == 0) | (b == 0)), F.lit(100.0)).otherwise(F.when(both > 0, F.greatest(whole, alone)).otherwise(whole))


def composite_score(a: Column, b: Column, ratio: Column) -> Column:
    """The greatest of F2, F2 of the words sorted or taken as sets, and, if one text is much longer, F2 of its best piece.

    Words count ``SORTED_WEIGHT``. From ``PARTIAL_FROM`` times the length pieces take the place of the whole words and count
    ``PARTIAL_WEIGHT`` (``FAR_WEIGHT`` beyond ``FAR_FROM`` times); a shared word makes the pieces of sorted words equal.
    """
    none = F.array().cast("array<string>")

    def asked(p: Column) -> Column:
        swap, alike = F.length(p["a"]) <= F.length(p["b"]), p["times"] < PARTIAL_FROM
        short, long = F.when(swap, p["a"]).otherwise(p["b"]), F.when(swap, p["b"]).otherwise(p["a"])
        short_sorted, long_sorted = F.when(swap, p["sa"]).otherwise(p["sb"]), F.when(swap, p["sb"]).otherwise(p["sa"])
        worded = p["sets"]["both"] != ""

        def item(x: Column, ys: Column, needed: Column) -> Column:
            return F.struct(x.alias("x"), F.when(needed, ys).otherwise(none).alias("ys"))

        questions = F.array(
            item(p["sa"], F.array(p["sb"]), alike),
            item(p["sets"]["a"], F.array(p["sets"]["b"]), alike & (p["sets"]["a"] != "") & (p["sets"]["b"] != "")),
            item(short, F.when(F.contains(long, short), F.array(short)).otherwise(pieces(short, long)), ~alike),
            item(short_sorted, F.when(worded, F.array(short_sorted)).otherwise(pieces(short_sorted, long_sorted)), ~alike),
        )
        return let(best_ratios(questions), lambda r: scored(p, r))

    def scored(p: Column, r: Column) -> Column:
        words = F.greatest(r[0], token_set_ratio(p["sets"], r[1])) * SORTED_WEIGHT
        weight = F.when(p["times"] <= FAR_FROM, F.lit(PARTIAL_WEIGHT)).otherwise(F.lit(FAR_WEIGHT))
        contained = F.greatest(r[2], r[3] * SORTED_WEIGHT) * weight
        return F.greatest(p["ratio"], F.when(p["times"] < PARTIAL_FROM, words).otherwise(contained))

    bound = F.struct(
        a.alias("a"), b.alias("b"), ratio.alias("ratio"), token_sort(a).alias("sa"), token_sort(b).alias("sb"), token_sets(a, b).alias("sets"),
        (F.greatest(F.length(a), F.length(b)) / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))).alias("times"),
    )
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(a == b, F.lit(100.0)).otherwise(let(bound, asked))
