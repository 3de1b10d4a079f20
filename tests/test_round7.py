"""Many rows take more tasks instead of larger ones, with the same rows as in few tasks."""

import pytest

from wishgrid import session
from wishgrid.operators import answers, catalog, gazetteer, poi, shortlist, skew

QUERIES = 40


@pytest.fixture
def candidates(spark):
    """50 places a query, some without coordinates, one row twice, one place with two coordinates."""
    rows = [
        (q, f"b{o}", o, f"c{o}", None if o % 11 == 3 else 55 + (o * 7 + q) % 90 / 100, 37 + o % 13 / 100, o % 3 == 0)
        for q in range(QUERIES)
        for o in range(50)
    ]
    rows += [rows[0], (1, "b1", 1, "c1", 55.95, 37.9, True)]
    return spark.createDataFrame(rows, "query_id int, place_id string, ord int, slug string, lat double, lon double, is_center boolean")


@pytest.fixture
def landmarks(spark):
    rows = [(q, 56.0 + i / 50, 37.0, None, True) for q in range(0, QUERIES, 2) for i in range(1 + 70 * (q == 4))]
    return spark.createDataFrame(rows, "query_id int, lat double, lon double, max_distance_m int, nearest_only boolean")


def operators(spark, candidates, landmarks):
    declared = shortlist.declared_maximum(landmarks)
    reqs = spark.createDataFrame([(q, c, 500) for q in range(QUERIES) for c in ("bank", "food")], "query_id int, category string, max_distance_m int")
    records = spark.createDataFrame(
        [(f"c{o}", c, 1, float(o * 20), "n", False, 1, 1, 30.0, 2) for o in range(0, 50, 2) for c in ("bank", "food")],
        "slug string, category string, count int, closest_distance_m double, closest_name string, closest_unnamed boolean,"
        " count_operational int, count_under_construction int, closest_under_construction_m double, schema_version int",
    )
    criteria = candidates.selectExpr("query_id", "query_id % 9 = 4 as center_requested").distinct()
    classes = landmarks.selectExpr("query_id", "max_distance_m").where("query_id % 5 = 0")
    return {
        "w2": lambda: shortlist.homonym_split(candidates, landmarks, 3000.0),
        "w4": lambda: shortlist.rank_by_points(candidates, landmarks, declared),
        "w5": lambda: shortlist.nearest_superlative(candidates, landmarks),
        "w6": lambda: shortlist.nearest_fallback(candidates, landmarks, declared, 100.0),
        "w7": lambda: shortlist.narrow(criteria, candidates, reqs, records, landmarks, classes, landmarks.where("query_id % 5 = 0")),
        "a2": lambda: poi.poi_evidence(reqs.select("query_id", "category"), candidates.select("query_id", "slug", "ord").distinct(), records),
    }


@pytest.mark.parametrize("name", ["w2", "w4", "w5", "w6", "w7", "a2"])
def test_rows_of_a_task_are_bounded(spark, candidates, landmarks, monkeypatch, name):
    make = operators(spark, candidates, landmarks)[name]
    few = make()
    want = sorted(map(str, few.collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 20)
    many = make()
    assert many.rdd.getNumPartitions() > few.rdd.getNumPartitions()
    assert sorted(map(str, many.collect())) == want and want


def test_a_line_calls_at_a_node_once(spark, monkeypatch):
    """40 relations of one line at the same two nodes: two rows meet the nodes, not 80."""
    kept = {}

    def keep(df, label):
        kept[label] = session.through_table(df, label)
        return kept[label]

    monkeypatch.setattr(catalog, "through_table", keep)
    tags = "map<string,string>"
    schema = f"type string, id int, lat double, lon double, tags {tags}, members array<struct<type: string, ref: int, role: string>>"
    stop = {"name": "Lake", "railway": "station", "alt_name": "Lake; The Lake"}
    rows = [("node", 1, 55.0, 37.0, stop, None), ("node", 2, 56.0, 38.0, {**stop, "alt_name": "Pond"}, None)]
    rows += [("relation", 10 + i, None, None, {"route": "train", "ref": "14"}, [("node", 1, ""), ("node", 2, ""), ("way", 1, "")]) for i in range(40)]
    rows += [("relation", 90, None, None, {"route": "subway", "name": "Blue: a"}, [("node", 2, "")])]
    out = catalog.stations_from_osm(spark.createDataFrame(rows, schema)).collect()
    assert [(r.name, r.lat, r.line, r.aliases) for r in out] == [("Lake", 55.0, "Blue / МЦК", ["Pond", "The Lake"])]
    assert kept["line-nodes"].count() == 3


def test_windows_left_out_are_not_made(spark):
    """Windows are chosen before they are cut, and keep the numbers they had among all."""
    long = ", ".join(f"дом {i} у реки" for i in range(40))
    rows = [(1, "жк Мечта, и; у реки Б 7 и Ясная"), (2, long)]
    tokens = gazetteer.text_tokens(spark.createDataFrame(rows, "query_id int, text string"))
    windows = gazetteer.token_windows(tokens)
    got = [(r.seq, r.window_text) for r in windows.where("query_id = 1").orderBy("seq").collect()]
    n = 9  # tokens; windows of one token are numbered from 0, of two from 9, of three from 17
    assert [(s, t) for s, t in got if s < n] == [(1, "Мечта"), (4, "реки"), (5, "Б"), (6, "7"), (8, "Ясная")]
    assert [(s, t) for s, t in got if n <= s < 2 * n - 1] == [(9, "жк Мечта"), (13, "реки Б"), (14, "Б 7")]
    numbered = gazetteer.token_windows(tokens, digits=True)
    assert sorted(numbered.select("query_id", "seq").collect()) == sorted(
        windows.where("rlike(window_text, '[0-9]')").select("query_id", "seq").collect()
    )


def test_tagged_blocks_are_kept_where_they_meet(spark):
    """Listed steps win over tags, the first tag over the second; the answer is that of all steps listed."""
    rows = [(q, s, f, n) for q in range(12) for s, f, n in ((1, "county", "A"), (2, "district", f"d{q % 3}")) if q % 4 < 3 or s == 2]
    wanted = spark.createDataFrame([*rows, (20, 1, "county", "none")], "query_id int, step int, field string, name string")
    held = [(f, n, f"b{o}", float(o)) for o in range(30) for f, n in (("county", "AB"[o % 2]), ("district", f"d{o % 5}"))]
    tags = spark.createDataFrame([*held, held[0]], "field string, name string, place_id string, ord double")
    near = spark.createDataFrame([(q, 0, f"b{q}", 0.5) for q in (0, 1, 2, 30)], "query_id int, step int, place_id string, ord double")
    sides = spark.createDataFrame([(q, None if q % 3 == 0 else q % 3 == 1) for q in (*range(12), 20, 30, 31)], "query_id int, within boolean")
    ring = spark.createDataFrame([(f"b{o}", o, o % 4 < 2) for o in range(28)], "place_id string, ord int, inside boolean")
    listed = wanted.join(tags, ["field", "name"]).select("query_id", "step", "place_id", "ord")
    want = sorted(map(str, answers.fallback_blocks(near.unionByName(listed), sides, ring).collect()))
    assert sorted(map(str, answers.fallback_blocks(near, sides, ring, wanted, tags).collect())) == want and want
