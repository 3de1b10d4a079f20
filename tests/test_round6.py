"""Faults of the sixth round: pairs are scored in batches, equal texts are searched for names once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wishgrid.functions.text import pair_similarity, similarity
from wishgrid.operators import gazetteer as gz
from wishgrid.operators.similar import similar_pairs

NONE = "cast(array() as array<string>) as aliases"


def test_batches_score_like_the_plain_expression(spark):
    rnd = random.Random(3)
    sizes = [0, 1, 2, 7, 13, 60, 61, 63, 64, 65, 90]
    rows = [tuple("".join(rnd.choices("abдё 😀"[:5], k=rnd.choice(sizes))) for _ in "ab") for _ in range(300)]
    pairs = spark.createDataFrame(rows, "a string, b string")
    got = pairs.select("a", "b", pair_similarity(F.col("a"), F.col("b")).alias("x"), similarity(F.col("a"), F.col("b")).alias("y")).collect()
    assert len(got) == 300 and all(r.x == r.y for r in got)


def test_pairs_are_found_at_any_shared_gram(spark):
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choices("abc 12", k=rnd.randint(2, 14))).strip() or "a" for _ in range(120)})
    df = spark.createDataFrame([(n,) for n in names], "a string")
    everything = df.crossJoin(df.select(F.col("a").alias("b"))).withColumn("score", similarity(F.col("a"), F.col("b")))
    for threshold in (67.0, 80.0, 88.0):
        want = {tuple(r) for r in everything.where(f"score >= {threshold} - 1e-9").collect()}
        found = [tuple(r) for r in similar_pairs(df, df.select(F.col("a").alias("b")), threshold).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def _entries(spark):
    return spark.range(1).selectExpr("1L as ord", "'complex' as type", "'large ring' as name", "'s' as slug", "'i' as id", NONE)


def test_equal_texts_are_searched_for_names_once(spark, monkeypatch):
    asked = []
    plain = gz.match_gazetteer
    monkeypatch.setattr(gz, "match_gazetteer", lambda texts, entries: asked.append(texts.count()) or plain(texts, entries))
    texts = ["в жк large ring", "нет", None]
    queries = spark.createDataFrame([(q, texts[q % 3]) for q in range(30)], "query_id long, text string")
    got = gz.named_entities(queries, _entries(spark)).collect()
    assert asked == [3] and sorted(r.query_id for r in got) == list(range(0, 30, 3))
    assert {(r.name, r.s, r.e) for r in got} == {("large ring", 0, 15)}


def test_equal_texts_are_searched_for_landmarks_once(spark, monkeypatch):
    asked = []
    plain = gz._landmarks_in
    monkeypatch.setattr(gz, "_landmarks_in", lambda texts, landmarks: asked.append(texts.count()) or plain(texts, landmarks))
    landmarks = _entries(spark).selectExpr("ord", "name", "aliases", "55.0D as lat", "37.0D as lon", "'x' as category")
    queries = spark.range(20).selectExpr("id as query_id", "case when id % 2 = 0 then 'дом рядом с large ring' else 'дом' end as text")
    got = gz.landmark_requirements(queries.withColumn("norm", F.col("text")), landmarks).collect()
    assert asked == [2] and sorted((r.query_id, r.name) for r in got) == [(q, "large ring") for q in range(0, 20, 2)]
