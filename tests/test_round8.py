"""Results far larger than both sides: arrays of rows meet and are taken apart, with the rows of a plain join."""

import re

import pytest
from pyspark.sql import functions as F

from wishgrid.operators import answers, catalog, listings, routes, skew, spatial


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(skew, "PACK", 4)
    monkeypatch.setattr(skew, "FEW", 3)
    monkeypatch.setattr(spatial, "PACK", 4)
    monkeypatch.setattr(spatial, "FEW", 3)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def initial_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_packed_join_is_a_join(spark, small):
    left = [("a" if i % 3 else "b", i if i % 7 else None, f"x{i % 5}") for i in range(40)] + [(None, 1, "x"), ("c", 2, "x"), ("b", 3, "y"), ("b", 3, "y")]
    right = [("a" if i % 2 else "b", i // 2, [f"t{i}"] if i % 4 else None) for i in range(23)] + [(None, 1, None), ("d", 2, None)]
    a = spark.createDataFrame(left, "k string, l long, x string")
    b = spark.createDataFrame(right, "k string, r int, t array<string>")
    assert rows(skew.join_packed(a, b, ["k"])) == rows(a.join(b, "k"))
    each = skew.join_packed(a.select("l", "x"), b.select("r"), [])
    assert rows(each) == rows(a.select("l", "x").crossJoin(b.select("r"))) and each.columns == ["l", "x", "r"]
    assert skew.join_packed(a.where("false"), b, ["k"]).isEmpty() and skew.join_packed(a.select("l"), b.select("r").where("false"), []).isEmpty()


def test_origins_are_no_nested_product(spark, small):
    none = "cast(array() as array<string>) as aliases"
    complexes = spark.range(30).selectExpr("id as ord", "concat('n', id) as name", none, "case when id % 5 > 0 then 55.0D end as lat", "37.0D as lon")
    criteria = spark.createDataFrame([(i,) for i in range(20)] + [(3,), (None,)], "query_id long")
    requested = spark.createDataFrame([(1, "n1"), (1, "n2"), (2, "n5"), (4, "zz")], "query_id long, name string")
    out = routes.origins(criteria, requested, complexes)
    located = [o for o in range(30) if o % 5]
    want = [(1, 1, False), (1, 2, False)] + [(q, o, True) for q in [*range(20), 3, None] if q != 1 for o in located]
    assert rows(out) == sorted(map(repr, want))
    assert "_lrows" in initial_plan(out)


def test_criteria_in_price_bins_stay_out_of_the_driver(spark):
    cards = spark.range(400).selectExpr(
        "id", "concat('b', id % 7) as block_id", "cast(id % 6 as int) as rooms", "case when id % 50 > 0 then 1000 + id * 211 end as price"
    )
    asked = [(1, 30000, None, []), (2, None, 20000, []), (3, None, None, []), (4, 20000, 21000, ["b1", "b1", "b9"]), (5, 90000, 1000, []), (1, 30000, None, [])]
    criteria = spark.createDataFrame(asked, "query_id int, price_min long, price_max long, blocks array<string>").withColumn(
        "rooms_any", F.expr("array(1, 3)")
    )
    out = listings.criteria_listings(criteria, cards)
    fits = "(price_min is null or price >= price_min) and (price_max is null or price <= price_max) and (array_contains(rooms_any, rooms) or rooms > 3)"
    want = criteria.crossJoin(cards).where(fits + " and (size(blocks) = 0 or array_contains(blocks, block_id))")
    names = ["query_id", "id", "block_id", "price"]
    assert rows(out.select(names)) == rows(want.select(names)) and not out.isEmpty()
    # what is sent round is the bins, never the criteria times bins or blocks
    joins = re.findall(r"(\w+Join) \[(.*?)\]", initial_plan(out))
    assert {kind for kind, keys in joins if "salt#" in keys} == {"SortMergeJoin"}


def test_places_of_tags_meet_queries_as_arrays(spark, small):
    near = spark.createDataFrame([(q, 0, f"p{(q * 5 + i) % 25}", float(i)) for q in range(0, 12, 3) for i in range(4)], "query_id int, step int, place_id string, ord double")
    sides = spark.createDataFrame([(q, [True, False, None][q % 3]) for q in range(16)], "query_id int, within boolean")
    ring = spark.createDataFrame([(f"p{i}", [True, False][i % 2]) for i in range(22)], "place_id string, inside boolean")
    wanted = spark.createDataFrame([(q, 1, "county", f"c{q % 2}") for q in range(9)] + [(q, 2, "district", f"d{q % 3}") for q in range(4, 12)], "query_id int, step int, field string, name string")
    tags = spark.createDataFrame([("county", f"c{i % 2}", f"p{i}", float(i)) for i in range(25)] + [("district", f"d{i % 4}", f"p{i}", float(i)) for i in range(25)], "field string, name string, place_id string, ord double")
    out = answers.fallback_blocks(near, sides, ring, wanted, tags)
    step = wanted.join(tags, ["field", "name"]).select("query_id", "step", "place_id", "ord")
    plain = answers.fallback_blocks(near.unionByName(step), sides, ring)
    assert rows(out.select("query_id", "place_id")) == rows(plain.select("query_id", "place_id")) and not out.isEmpty()
    assert initial_plan(out).count("_lrows") > initial_plan(plain).count("_lrows") > 0


def test_names_of_many_queries_meet_as_arrays(spark, small):
    complexes = spark.createDataFrame(
        [(i, f"d{i % 3}", f"c{i % 2}", f"c{i % 4}" if i % 6 else None) for i in range(30)], "ord int, district string, county string, metro string"
    )
    wanted = spark.createDataFrame([(q, f"{t}{(q + j) % 4}") for q in range(12) for j, t in enumerate("dcc")] + [(1, None), (2, "zz")], "query_id int, name string")
    out = catalog.location_filter(complexes, wanted)
    tags = complexes.selectExpr("ord", "explode(array(district, county, metro)) as name")
    assert rows(out) == rows(wanted.join(tags, "name").select("query_id", "ord").distinct())
    assert "_lrows" in initial_plan(out)


@pytest.mark.parametrize("digits", [None, 1])
def test_rows_of_a_coordinate_travel_as_arrays(spark, small, digits):
    points = spark.createDataFrame([(i, 55.0 + i % 3 / 100, 37.0) for i in range(20)] + [(3, 55.0, 37.0), (None, 55.0, 37.0), (99, None, 37.0)], "point_id int, lat double, lon double")
    places = spark.createDataFrame([(f"b{i}", i, 55.0 + i % 4 / 100, 37.0) for i in range(30)] + [("b1", 1, 55.01, 37.0), (None, 7, 55.0, 37.0), ("no", 8, None, None)], "place_id string, ord int, lat double, lon double")
    out = spatial.radius_join(points, places, 1500.0, **({"digits": digits} if digits else {}))
    p, q = spatial._as_points(points), spatial._as_places(places)
    plain = p.join(spatial.coordinate_pairs(p, q, 1500.0), ["p_lat", "p_lon"]).join(q, ["q_lat", "q_lon"]).select("point_id", "place_id", "ord", "dist_m")
    if digits:
        plain = plain.withColumn("dist_m", F.round("dist_m", digits))
    assert rows(out) == rows(plain) and not out.isEmpty()
    assert "collect_list" in initial_plan(out)
