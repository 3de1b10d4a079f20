"""Points in rings against a ray to infinity over every edge."""

import math
import random

import pytest

from wishgrid.operators.spatial import point_in_ring, ring_cover, rings_containing

EDGES = "ring_id string, lat1 double, lon1 double, lat2 double, lon2 double"


def edges(name, corners):
    """``corners`` as (lat, lon)."""
    return [(name, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]


def star(draw, n, lat, lon, size):
    turns = sorted(draw.random() * 2 * math.pi for _ in range(n))
    return [(lat + r * math.sin(t), lon + r * math.cos(t)) for t in turns for r in [size * (0.2 + 0.8 * draw.random())]]


def inside(lat, lon, ring):
    odd = False
    for _, lat1, lon1, lat2, lon2 in ring:
        if (lat1 > lat) != (lat2 > lat) and lon < lon1 + (lat - lat1) / (lat2 - lat1) * (lon2 - lon1):
            odd = not odd
    return odd


@pytest.fixture(scope="module")
def rings():
    draw = random.Random(8)
    made = {f"star{k}": edges(f"star{k}", star(draw, 3 + 9 * k, draw.uniform(-60, 60), draw.uniform(-90, 90), 4.0 ** draw.randint(-3, 2))) for k in range(14)}
    # Corners on borders of cells, edges along parallels and meridians, a hole, a loop that crosses itself, edges given twice.
    made["square"] = edges("square", [(0.0, 0.0), (0.0, 8.0), (8.0, 8.0), (8.0, 0.0)])
    made["hole"] = edges("hole", [(0.0, 0.0), (0.0, 8.0), (8.0, 8.0), (8.0, 0.0)]) + edges("hole", [(2.0, 2.0), (6.0, 2.0), (6.0, 6.5), (2.0, 6.5)])
    made["stairs"] = edges("stairs", [(0.0, 0.0), (0.0, 4.0), (1.0, 4.0), (1.0, 3.0), (2.0, 3.0), (2.0, 2.0), (3.0, 2.0), (3.0, 0.0)])
    made["bow"] = edges("bow", [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)])
    made["twice"] = 2 * edges("twice", [(0.0, 0.0), (0.0, 3.0), (3.0, 3.0)])
    made["line"] = edges("line", [(0.0, 0.0), (5.0, 5.0), (2.0, 2.0)])
    made["dot"] = edges("dot", [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)])
    return made


@pytest.fixture(scope="module")
def spots(rings):
    draw = random.Random(9)
    out = [(x / 4, y / 4) for x in range(-2, 36) for y in range(-2, 36)]
    for ring in rings.values():
        lats, lons = [e[1] for e in ring], [e[2] for e in ring]
        out += [(e[1], e[2]) for e in ring] + [((e[1] + e[3]) / 2, (e[2] + e[4]) / 2) for e in ring]
        out += [(draw.uniform(min(lats), max(lats)), draw.uniform(min(lons), max(lons))) for _ in range(150)]
        out += [(draw.choice(lats), draw.uniform(min(lons), max(lons))) for _ in range(40)]
        out += [(draw.uniform(min(lats), max(lats)), draw.choice(lons)) for _ in range(40)]
    return out


def test_equals_a_ray_over_all_edges(spark, rings, spots):
    points = spark.createDataFrame([*spots, *spots[:50], (None, 1.0), (1.0, None)], "lat double, lon double")
    table = spark.createDataFrame([e for ring in rings.values() for e in ring], EDGES)
    got = [tuple(r) for r in rings_containing(points, table).collect()]
    want = {(lat, lon, name) for name, ring in rings.items() for lat, lon in set(spots) if inside(lat, lon, ring)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3000


def test_points_far_inside_meet_one_row(spark):
    turns = [2 * math.pi * k / 4000 for k in range(4000)]
    ring = edges("r", [(55.7 + 0.3 * math.sin(t), 37.6 + 0.3 * math.cos(t)) for t in turns])
    cover = ring_cover(spark.createDataFrame(ring, EDGES)).cache()
    cells = cover.groupBy("row", "col").agg({"lat1": "count", "ring_id": "count"}).toDF("row", "col", "edges", "rows").toPandas()
    assert len(cells) < 20 * len(ring) and (cells.rows - cells.edges <= 1).all()
    assert (cells.edges == 0).mean() > 0.9 and cells.edges.max() < 60


def test_a_hot_cell_a_broken_ring_and_nothing(spark):
    square = edges("s", [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)])
    table = spark.createDataFrame([*square, ("broken", 0.0, 0.0, None, 1.0), ("broken", 0.0, 1.0, 0.0, 0.0)], EDGES)
    crowd = spark.range(20000).selectExpr("id as place_id", "0.5 + id * 1e-9 as lat", "0.5D as lon")
    assert rings_containing(crowd, table).groupBy("ring_id").count().collect() == [("s", 20000)]
    assert rings_containing(crowd, table.where("ring_id = 'broken'")).collect() == []
    assert rings_containing(crowd.limit(0), table).collect() == []
    assert {r.inside for r in point_in_ring(crowd.limit(9), table.limit(0)).collect()} == {False}
