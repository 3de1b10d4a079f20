"""Similarity join on texts (F2 as a join), exact for thresholds of 67 and more."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wishgrid.functions.text import pair_similarity
from wishgrid.operators.skew import join_split
from wishgrid.session import through_table

MIN_THRESHOLD = 200.0 / 3.0


def _grams(df: DataFrame, text: str) -> DataFrame:
    """Padded bigrams, repeated ones numbered, so that a text is a *set* of grams."""
    padded = F.concat(F.lit("\x01"), F.col(text), F.lit("\x02"))
    return (
        df.withColumn("_p", padded)
        .withColumn("_g", F.expr("transform(sequence(1, length(_p) - 1), i -> substring(_p, i, 2))"))
        .withColumn(
            "grams",
            F.expr(
                "transform(_g, (g, i) -> concat(g, size(filter(slice(_g, 1, i + 1), x -> x = g))))"
            ),
        )
        .drop("_p", "_g")
    )


def _prefix(df: DataFrame, text: str, rarity: DataFrame, threshold: float) -> DataFrame:
    """The rarest grams of every text that any partner must share one of, and their places (from 0) among its grams by rarity.

    Texts of lengths ``la`` and ``lb`` with ratio ``t`` share at least
    ``1 + (1.5 t - 1)(la + lb)`` padded bigrams (each deletion destroys two of them, each insertion
    one), and ``lb >= la t / (2 - t)``.
    """
    t = threshold / 100.0
    shared = f"ceil(1 + {1.5 * t - 1:.12f} * length({text}) * (1 + {t / (2 - t):.12f}) - 1e-9)"
    return (
        _grams(df, text)
        .select(text, F.explode("grams").alias("gram"))
        .join(rarity, "gram", "left")
        .groupBy(text)
        .agg(F.expr("array_sort(collect_list(struct(coalesce(freq, 0L) as freq, gram)))").alias("g"))
        .withColumn("g", F.expr(f"slice(g, 1, cast(length({text}) + 2 - {shared} as int))"))
        .select(text, F.posexplode("g.gram").alias(f"{text}_at", "gram"))
    )


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``left(a)``, ``right(b)`` -> pairs ``(a, b)`` of distinct texts, among them all with similarity >= ``threshold``."""
    return _meetings(left, right, threshold).distinct()


def _meetings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The candidates, a pair as often as it meets.

    Candidates share one of their rarest bigrams (prefix filter), which loses no pair and keeps frequent bigrams out of the
    join; a frequent one is split by a salt. At the first gram that two texts share, by rarity, enough others must be left on
    either side; a pair that is kept at no shared gram is not similar.
    """
    if threshold < MIN_THRESHOLD:
        raise ValueError("below 67 two texts may share no bigram")
    # texts and their grams are read several times below: what they are made of is worked out once
    a = through_table(left.select("a").where("a <> ''").distinct(), "asked-texts")
    b = through_table(right.select("b").where("b <> ''").distinct(), "given-texts")
    rarity = through_table(
        _grams(b, "b").select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("freq")), "grams"
    )
    # Lengths differ by a bounded factor, so texts meet in neighbouring geometric length bands only.
    t = threshold / 100.0
    ratio = max((2 - t) / t, 1.001)
    band_of = f"cast(floor(ln(length({{0}})) / {math.log(ratio):.12f} + 1e-9) as int)"
    keys_a = _prefix(a, "a", rarity, threshold).withColumn(
        "band", F.explode(F.expr(f"transform(array(-1, 0, 1), d -> d + {band_of.format('a')})"))
    )
    keys_b = through_table(_prefix(b, "b", rarity, threshold).withColumn("band", F.expr(band_of.format("b"))), "given-grams")
    close = f"least(length(a), length(b)) * 2 >= {t:.12f} * (length(a) + length(b)) - 1e-9"
    return (
        join_split(keys_a, keys_b, ["gram", "band"], ["b"], 20000)
        .where(close)
        .where(f"least(length(a) - a_at, length(b) - b_at) + 1 >= 1 + {1.5 * t - 1:.12f} * (length(a) + length(b)) - 1e-9")
        .select("a", "b")
    )


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All pairs ``(a, b, score)`` of distinct texts with similarity >= ``threshold``; ``left(a)``, ``right(b)``."""
    # scoring a pair again costs less than shuffling all candidates to tell equal ones
    scored = _meetings(left, right, threshold).select("a", "b", pair_similarity(F.col("a"), F.col("b")).alias("score"))
    return scored.where(F.col("score") >= threshold - 1e-9).distinct()
