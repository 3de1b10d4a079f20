"""Distances to sets of points and counts within reach, against every pair."""

import math
import random
from collections import defaultdict

import pytest

from wishgrid.operators.shortlist import distances, fallback_notes
from wishgrid.operators.spatial import count_in_reach, min_distance, with_nearest

R = 6371000.0


def arc(a, b):
    s = math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    t = math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    h = s + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * t
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))


@pytest.fixture(scope="module")
def made():
    """Query 0 holds a third of all rows; the others have few points, few spots, none, or copies; some lie at the poles and the date line."""
    draw = random.Random(4)

    def spot():
        return draw.choice([
            (draw.uniform(55, 56), draw.uniform(37, 38)), (draw.uniform(-90, 90), draw.uniform(-180, 180)),
            (draw.uniform(89.9, 90), draw.uniform(-180, 180)), (draw.uniform(-1, 1), draw.choice([-179.99, 179.99])),
        ])

    sizes = {0: (400, 300), 1: (3, 200), 2: (200, 2), 3: (90, 80), 4: (5, 0), 5: (0, 5), 6: (1, 1)}
    spots = [(q, f"p{q}-{i}", *spot()) for q, (n, _) in sizes.items() for i in range(n)]
    targets = [(q, *spot()) for q, (_, m) in sizes.items() for _ in range(m)]
    spots += [(0, "nowhere", None, 1.0), (0, "p0-0", *spots[0][2:]), (3, "on it", *next(t for t in targets if t[0] == 3)[1:])]
    targets += [(0, None, None), targets[0], targets[0]]
    return spots, targets


@pytest.fixture(scope="module")
def tables(spark, made):
    return (
        spark.createDataFrame(made[0], "query_id int, place_id string, lat double, lon double"),
        spark.createDataFrame(made[1], "query_id int, lat double, lon double"),
    )


def test_nearest_of_every_group(made, tables):
    got = {(r.query_id, r.place_id): r.dist_m for r in min_distance(*tables).collect()}
    by_query = defaultdict(list)
    for q, *t in made[1]:
        if t[0] is not None:
            by_query[q].append(t)
    want = {(q, i): min(arc(t, (lat, lon)) for t in by_query[q]) for q, i, lat, lon in made[0] if lat is not None and by_query[q]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    rows = distances(*tables).collect()
    assert len(rows) == len(set(made[0])) and {r.place_id for r in rows if r.query_id == 4 and not r.pointed} == {f"p4-{i}" for i in range(5)}
    assert [(r.dist_m, r.pointed) for r in rows if r.place_id == "nowhere"] == [(None, True)]


def test_many_spots_of_one_target(spark):
    many = spark.range(30000).selectExpr("1 as query_id", "cast(id as string) as place_id", "55 + id * 1e-6 as lat", "37.0D as lon")
    one = spark.createDataFrame([(1, 55.0, 37.0)], "query_id int, lat double, lon double")
    assert with_nearest(many, one, "query_id").where("dist_m is not null").count() == 30000
    assert min_distance(many, one).agg({"dist_m": "max"}).first()[0] == pytest.approx(arc((55, 37), (55 + 0.029999, 37)), abs=1e-3)
    assert min_distance(many.limit(0), one).collect() == min_distance(many, one.limit(0)).collect() == []


@pytest.mark.parametrize("radius", [900.0, 150_000.0, 4_000_000.0, 25_000_000.0])
def test_counts_within_reach(spark, made, tables, radius):
    places, anchors = tables
    found = [(lat, lon) for _, _, lat, lon in made[0] if lat is not None]
    by_query = defaultdict(list)
    for q, *t in made[1]:
        if t[0] is not None:
            by_query[q].append(t)
    want = {q: sum(any(arc(t, p) <= radius for t in ts) for p in found) for q, ts in by_query.items()}
    got = {r.query_id: r.inside for r in count_in_reach(anchors, places, radius).collect()}
    assert got == {q: n for q, n in want.items() if n}
    if radius == 150_000.0:
        located = places.selectExpr("place_id", "cast(row_number() over (order by place_id) as int) as ord", "lat", "lon")
        notes = {r.query_id: r for r in fallback_notes(anchors.select("query_id").distinct(), located, anchors, radius).collect()}
        near = {q: min(arc(t, p) for t in ts for p in found) for q, ts in by_query.items()}
        for q, n in want.items():
            assert notes[q].other_region == len(found) - n and notes[q].unlocatable == 1
            assert (notes[q].nearest_m is None) == (near[q] > radius) and (near[q] > radius or abs(notes[q].nearest_m - near[q]) < 1e-3)
