"""Small fixtures for geometry, facts, catalogues, similarity and streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wishgrid.functions.geo import haversine_m, is_center
from wishgrid.functions.text import similarity
from wishgrid.functions.vectors import cosine_distance
from wishgrid.operators import catalog, facts, gazetteer, poi, spatial, usage, vectors
from wishgrid.operators.similar import similar_pairs
from wishgrid.sources import catalog as sources
from wishgrid.sources.ring import edges_of_ring, read_polygon, sample_ring


def hav(a, b, c, d):
    p = math.radians
    x = math.sin(p(c - a) / 2) ** 2 + math.cos(p(a)) * math.cos(p(c)) * math.sin(p(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_city_pair_and_centre(spark):
    row = spark.range(1).select(
        haversine_m(F.lit(55.7558), F.lit(37.6173), F.lit(59.9343), F.lit(30.3351)).alias("d"),
        is_center(F.lit(55.61792), F.lit(37.41610)).alias("far"),
        haversine_m(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("zero"),
    ).first()
    assert 600_000 < row["d"] < 650_000 and row["far"] is False and row["zero"] == 0.0


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_match_brute_force(spark, k):
    rng = random.Random(7)
    spots = [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(40)] + [(55.0, 37.0)] * 10 + [(89.9, 0.0), (0.0, 179.9999)]
    pts = [(i, *p) for i, p in enumerate([(55.0, 37.0), (89.9, 180.0), (0.0, -179.9999), (-45.0, 10.0)])]
    places = spark.createDataFrame([(f"p{i}", i, *s) for i, s in enumerate(spots)], "place_id string, ord long, lat double, lon double")
    points = spark.createDataFrame(pts, "point_id long, lat double, lon double")
    got = {}
    for r in spatial.nearest_k(points, places, k).collect():
        got.setdefault(r["point_id"], []).append((r["rn"], r["ord"]))
    for pid, lat, lon in pts:
        order = sorted(range(len(spots)), key=lambda i: (hav(lat, lon, *spots[i]), i))[:k]
        assert [o for _, o in sorted(got[pid])] == order
    near = {(r["point_id"], r["ord"]) for r in spatial.radius_join(points, places, 100_000.0).collect()}
    want = {(pid, i) for pid, lat, lon in pts for i, s in enumerate(spots) if hav(lat, lon, *s) <= 100_000.0}
    assert near == want


def test_ring_sides_are_disjoint(spark, tmp_path):
    doc = tmp_path / "ring.json"
    doc.write_text(json.dumps({"ring_lonlat": [list(v) for v in sample_ring()]}))
    edges = read_polygon(spark, str(doc))
    assert edges.count() == len(sample_ring()) == edges_of_ring(spark, sample_ring()).count()
    pts = spark.createDataFrame([("in", 55.72, 37.5), ("out", 55.95, 37.5), ("none", None, None)], "place_id string, lat double, lon double")
    assert {r["place_id"]: r["inside"] for r in spatial.point_in_ring(pts, edges).collect()} == {"in": True, "out": False}


def test_station_prefixes(spark):
    st = spark.createDataFrame(
        [(1, "Санино", "МЦД-2", 55.8, 37.6), (2, "Курская", "Арбатско-Покровская", 55.758, 37.66), (3, "X", "МЦД-2", None, None)],
        "ord long, name string, line string, lat double, lon double",
    )
    ask = spark.createDataFrame([("МЦД",), ("метро",)], "line_prefix string")
    got = sorted((r["line_prefix"], r["ord"]) for r in spatial.station_points(st, ask).collect())
    assert got == [("МЦД", 1), ("метро", 1), ("метро", 2)]


def test_similarity_values(spark):
    rows = [("раменках", "раменки", 80.0), ("химках", "химки", 72.7), ("первое", "перово", 83.3), ("a" * 70, "a" * 69 + "b", 98.6)]
    df = spark.createDataFrame(rows, "a string, b string, w double")
    for r in df.select("w", F.round(similarity(F.col("a"), F.col("b")), 1).alias("s")).collect():
        assert r["s"] == r["w"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ca in a:
        new = [0]
        for j, cb in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if ca == cb else 0))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [67.0, 80.0, 93.0])
def test_similarity_join_loses_no_pair(spark, threshold):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(120)]
    left, right = sorted(set(words[:60])), sorted(set(words[60:]))
    got = {
        (r["a"], r["b"])
        for r in similar_pairs(
            spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "b string"), threshold
        ).collect()
    }
    want = {(a, b) for a in left for b in right if 200.0 * lcs(a, b) / (len(a) + len(b)) >= threshold - 1e-9}
    assert got == want


def test_fold_keeps_trailing_run(spark):
    rows = [
        (i, f"2024-01-0{1 + i // 2} 0{i}:00:00", "v", v, c)
        for i, (v, c) in enumerate([("a", 0.9), ("a", 0.8), ("b", 0.7), ("b", 0.3), ("b", 0.6), ("a", 0.2)])
    ]
    df = spark.createDataFrame(rows, "event_order long, t string, subject_type string, fact_value string, confidence double").selectExpr(
        "event_order", "cast(t as timestamp) as observed_at", "subject_type", "'s' as subject_id", "'f' as fact_type", "fact_value", "'ai' as source", "confidence"
    )
    for upto, conf, conflicts in ((6, 0.2, 2), (5, 0.7, 1), (2, 0.9, 0)):
        r = facts.fold_facts(df.where(f"event_order < {upto}"), chunk_seconds=86400).first()
        assert (r["confidence"], r["conflicts"], r["observed_count"]) == (conf, conflicts, upto)


def test_alias_votes(spark):
    schema = "fact_id long, subject_type string, subject_id string, phrase string, observed_count long, confidence double"
    rows = [(1, "option", "s1", "Вид", 3, 0.9), (2, "option", "s1", "вид", 4, 0.5), (3, "option", "s1", "лес", 1000, 0.9), (4, "option", "s2", "лес", 1, 0.9), (5, "option", "s3", "сад", 2, 0.9)]
    got = {r["phrase"]: r["status"] for r in facts.alias_votes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"вид": "promotable", "лес": "ambiguous", "сад": "silent"}


def test_poi_promotion(spark):
    said = spark.createDataFrame(
        [("complex", "1", "poi_school", '{"present":true}'), ("complex", "1", "poi_shop", '{"present":true}'), ("complex", "1", "poi_bank", '{"present":false}'), ("complex", "9", "poi_bank", '{"present":false}')],
        "subject_type string, subject_id string, fact_type string, fact_value string",
    )
    known = spark.createDataFrame([("c1", "school", 5, 0, 2), ("c1", "shop", 1, 0, 1)], "slug string, category string, count int, count_operational int, schema_version int")
    complexes = spark.createDataFrame([("1", "c1")], "id string, slug string")
    out = facts.promote_poi(said, complexes, known)
    assert {(r["subject_id"], r["category"]): r["outcome"] for r in out.collect()} == {
        ("1", "school"): "rejected", ("1", "shop"): "agreed", ("1", "bank"): "inserted", ("9", "bank"): "ignored"}
    assert facts.poi_after_promotion(out, known).count() == 3


def _log(spark, rows):
    names = "had_poi_or_center fully_resolved_deterministically cache_hit ai_called criteria_changed_by_ai ai_failed".split()
    return spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names))


def test_usage_report(spark):
    t, f = True, False
    rows = [(t, t, f, t, t, f), (t, t, f, t, t, f), (t, t, f, t, f, f), (t, f, t, f, f, f), (t, f, f, t, t, f), (t, f, f, t, t, f), (f, f, t, f, f, f), (f, f, f, t, t, f), (f, f, f, f, f, f), (f, f, f, f, f, f)]
    r = usage.usage_report(_log(spark, rows)).first()
    assert [r[c] for c in list(usage.COUNTS)[:8]] == [10, 6, 3, 2, 6, 5, 5, 1]
    assert [r[c] for c in list(usage.SHARES)[:5]] == [60.0, 50.0, 20.0, 83.3, 20.0]
    empty = usage.usage_report(_log(spark, [(t, t, f, t, t, f)]).where("false")).first()
    assert empty["total"] == 0 and empty["pct_cache_hit"] == 0.0
    failed = usage.usage_report(_log(spark, [(f, f, f, t, f, f), (f, f, f, f, f, t), (f, f, f, t, f, t), (f, f, f, f, f, f)])).first()
    assert failed["ai_attempts"] == 3 and failed["pct_ai_failed"] == 66.7


def test_line_labels(spark):
    cases = [
        ({"route": "subway", "name": "Сокольническая линия: Потапово → Бульвар"}, "Сокольническая"),
        ({"route": "subway", "name": "Большая кольцевая линия (внутреннее кольцо)"}, "Большая кольцевая"),
        ({"route": "train", "ref": "14"}, "МЦК"),
        ({"route": "train", "ref": "D2", "network": "МЦД"}, "МЦД-2"),
        ({"route": "train", "ref": "D4А", "network": "МЦД"}, "МЦД-4"),
        ({"route": "train", "ref": "001А", "network": "РЖД"}, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    got = {r["i"]: r["l"] for r in df.select("i", catalog.line_label().alias("l")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_refresh_is_idempotent(spark):
    feed = spark.createDataFrame(
        [(0, 11, "Альфа", "/alpha/", "М1", "Р1", 55.1, 37.1, "Москва", 3, "ЦАО", "cao"), (1, 12, "Бета", "", None, "Р2", 0.0, None, "Область", 4, "Y", "y"), (2, 13, "", "/x/", None, None, None, None, None, None, None, None)],
        "pos long, id long, name string, url string, metro string, district string, latitude double, longitude double, p string, cid long, cname string, curl string",
    ).selectExpr("*", "named_struct('parent', named_struct('name', p), 'child', named_struct('id', cid, 'name', cname, 'url', curl)) as locations")
    base = spark.createDataFrame(
        [("complexes", 0, "Старая Альфа", "alpha", None, ["кличка"]), ("complexes", 1, "Ручная", None, "99", [])],
        "kind string, ord long, name string, slug string, id string, aliases array<string>",
    )
    for c, t in (("lat", "double"), ("lon", "double"), ("district", "string"), ("county", "string"), ("metro", "string")):
        base = base.withColumn(c, F.lit(None).cast(t))
    once = catalog.merge_catalog(base, catalog.complexes_from_feed(feed))
    rows = {r["name"]: r for r in once.collect()}
    assert set(rows) == {"Альфа", "Ручная", "Бета"}
    assert rows["Альфа"]["id"] == "11" and rows["Альфа"]["county"] == "ЦАО" and rows["Альфа"]["aliases"] == ["кличка"]
    twice = catalog.merge_catalog(sources.file_order(once), catalog.complexes_from_feed(feed))
    assert sorted((r["name"], r["slug"] or "", r["id"]) for r in twice.collect()) == sorted((r["name"], r["slug"] or "", r["id"]) for r in once.collect())


def test_catalog_files(spark, tmp_path):
    for kind, name in sources.CATALOG_FILES.items():
        rows = [{"name": f"{kind}-b"}, {"name": f"{kind}-a", "aliases": ["x"], "odd": 1}] if kind == "metro" else [{"name": kind}]
        (tmp_path / name).write_text(json.dumps(rows))
    table = sources.read_catalog(spark, str(tmp_path))
    assert [(r["ord"], r["name"]) for r in table.where("kind = 'metro'").orderBy("ord").collect()] == [(0, "metro-b"), (1, "metro-a")]
    assert table.count() == 9
    assert [(r["kind"], r["field"]) for r in sources.unknown_fields(spark, str(tmp_path)).collect()] == [("metro", "odd")]


def test_building_site_does_not_satisfy(spark):
    complexes = spark.createDataFrame([("c1", 55.75, 37.6)], "slug string, lat double, lon double")
    elements = spark.createDataFrame(
        [(1, None, None, (55.75 + 186 / 111195, 37.6), {"amenity": "kindergarten", "landuse": "construction"}), (2, 55.75 + 300 / 111195, 37.6, None, {"amenity": "kindergarten", "name": "Сад"})],
        "id long, lat double, lon double, center struct<lat: double, lon: double>, tags map<string,string>",
    )
    r = poi.poi_profile(complexes, elements).where("category = 'kindergarten'").first()
    assert (r["count_operational"], r["count_under_construction"], r["closest_name"]) == (1, 1, "Сад")
    assert r["closest_under_construction_m"] < 200 < r["closest_distance_m"] < 350


def test_vector_lookup_matches_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    vec = lambda: [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]
    q, c = [(i, vec()) for i in range(60)], [(i, vec()) for i in range(150)]
    qs = spark.createDataFrame(q, "query_id long, embedding array<float>")
    cs = spark.createDataFrame(c, "id long, embedding array<float>")
    got = {r["query_id"]: r["id"] for r in vectors.semantic_lookup(qs, cs, 0.05, 8).collect()}
    pairs = qs.crossJoin(cs.withColumnRenamed("embedding", "e2")).withColumn("d", cosine_distance(F.col("embedding"), F.col("e2"), 8))
    best = pairs.groupBy("query_id").agg(F.min(F.struct("d", "id")).alias("b")).where("b.d <= 0.05")
    assert got == {r["query_id"]: r["b"]["id"] for r in best.collect()} and got


def test_landmark_gets_distance_and_superlative(spark):
    from wishgrid.functions.text import normalize_chars

    lm = spark.createDataFrame([(0, "МГУ им. Ломоносова", ["мгу"], 55.7, 37.5, "university"), (1, "Бауманка", [], 55.7, 37.6, None)], "ord long, name string, aliases array<string>, lat double, lon double, category string")
    qs = spark.createDataFrame([(1, "как можно ближе к МГУ не дальше 2 км"), (2, "рядом с бауманкой")], "query_id int, text string").withColumn("norm", normalize_chars("text"))
    got = {r["query_id"]: (r["name"], r["nearest_only"], r["max_distance_m"]) for r in gazetteer.landmark_requirements(qs, lm).collect()}
    assert got[1] == ("МГУ им. Ломоносова", True, 2000)


def test_stream_replay_in_several_batches_equals_batch(spark, sf, tmp_path):
    from wishgrid.queries.facts import observations
    from wishgrid.streaming.facts import fold_facts_stream, folded_facts

    obs = observations(spark, sf).withColumn("observed_at", F.expr("cast(observed_at as timestamp)"))
    days = obs.selectExpr("date_format(observed_at, 'dd') as d").distinct().orderBy("d").collect()
    for i, day in enumerate(days):
        part = obs.where(F.date_format("observed_at", "dd") == day["d"]).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        if i >= 3:
            break
    kept = [d["d"] for d in days[:4]]
    rows = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    job = fold_facts_stream(rows, state).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    cols = ["subject_id", "fact_type", "fact_value", "confidence", "observed_count", "conflicts"]
    batch = facts.fold_facts(obs.where(F.date_format("observed_at", "dd").isin(kept)))
    assert sorted(folded_facts(spark, state).select(*cols).collect()) == sorted(batch.select(*cols).collect())
