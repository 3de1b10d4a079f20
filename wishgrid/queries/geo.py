"""Spatial operators over suppliers (places), customers (points) and parts (stations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishgrid.functions.geo import is_center
from wishgrid.operators import spatial
from wishgrid.queries.base import (
    SQL_PLACES,
    SQL_POINTS,
    SQL_STATIONS,
    places,
    points,
    sql_hav,
    sql_key,
    stations,
    table,
    with_sql,
)
from wishgrid.queries.registry import query
from wishgrid.sources.ring import edges_of_ring, sample_ring

DIST = sql_hav("p.lat", "p.lon", "q.lat", "q.lon")


@query(
    "j4_radius_join",
    with_sql(SQL_POINTS, SQL_PLACES)
    + f"""SELECT p.point_id, q.place_id, round({DIST}, 1) AS dist_m
FROM points p JOIN places q ON {DIST} <= 5000""",
)
def j4_radius_join(spark, sf):
    hits = spatial.radius_join(points(spark, sf), places(spark, sf), 5000.0)
    return hits.select("point_id", "place_id", F.round("dist_m", 1).alias("dist_m"))


@query(
    "j5_nearest_k",
    with_sql(SQL_POINTS, SQL_PLACES)
    + f"""SELECT point_id, place_id, round(dist, 1) AS dist_m, rn FROM (
  SELECT p.point_id, q.place_id, {DIST} AS dist,
         row_number() OVER (PARTITION BY p.point_id ORDER BY {DIST}, q.ord) AS rn
  FROM points p CROSS JOIN places q WHERE q.lat IS NOT NULL) WHERE rn <= 3""",
)
def j5_nearest_k(spark, sf):
    near = spatial.nearest_k(points(spark, sf), places(spark, sf), 3)
    return near.select(
        "point_id", "place_id", F.round("dist_m", 1).alias("dist_m"), F.col("rn").cast("long").alias("rn")
    )


SQL_J6 = (
    with_sql(SQL_POINTS, SQL_PLACES)
    + f"""SELECT point_id, place_id, round(dist, 1) AS dist_m, round(nearest, 1) AS nearest_m,
       nearest <= 1500 AS within FROM (
  SELECT p.point_id, q.place_id, {DIST} AS dist,
         min({DIST}) OVER (PARTITION BY p.point_id) AS nearest,
         row_number() OVER (PARTITION BY p.point_id ORDER BY {DIST}, q.ord) AS rn
  FROM points p CROSS JOIN places q WHERE q.lat IS NOT NULL)
WHERE dist <= 1500 OR (nearest > 1500 AND rn <= 8)"""
)


@query("j6_radius_or_nearest", SQL_J6)
def j6_radius_or_nearest(spark, sf):
    hits = spatial.radius_or_nearest(points(spark, sf), places(spark, sf), 1500.0, 8)
    return hits.select(
        "point_id",
        "place_id",
        F.round("dist_m", 1).alias("dist_m"),
        F.round("nearest_m", 1).alias("nearest_m"),
        "within",
    )


# Query of J7: the orders of a customer; candidates are the suppliers of its lines, anchors the
# stations (parts) of its lines.
@query(
    "j7_min_distance",
    with_sql(SQL_PLACES, SQL_STATIONS)
    + f"""SELECT query_id, place_id, round(min({DIST}), 1) AS dist_m FROM (
  SELECT DISTINCT l_orderkey AS query_id, place_id, lat, lon
  FROM lineitem JOIN places ON l_suppkey = ord WHERE lat IS NOT NULL) q
JOIN (SELECT l_orderkey AS query_id, lat, lon
      FROM lineitem JOIN stations ON l_partkey = ord WHERE lat IS NOT NULL) p USING (query_id)
GROUP BY query_id, place_id""",
)
def j7_min_distance(spark, sf):
    lines = table(spark, sf, "lineitem")
    candidates = (
        lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("ord"))
        .distinct()
        .join(places(spark, sf).select("ord", "place_id", "lat", "lon"), "ord")
    )
    anchors = lines.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("ord")
    ).join(stations(spark, sf).select("ord", "lat", "lon"), "ord")
    out = spatial.min_distance(candidates, anchors)
    return out.select("query_id", "place_id", F.round("dist_m", 1).alias("dist_m"))


def _ring_values() -> str:
    ring = sample_ring()
    pairs = zip(ring, ring[1:] + ring[:1], strict=True)
    return ", ".join(f"({a[1]!r}, {a[0]!r}, {b[1]!r}, {b[0]!r})" for a, b in pairs)


SQL_RING = f"edges(lat1, lon1, lat2, lon2) AS (VALUES {_ring_values()})"


@query(
    "j8_point_in_ring",
    with_sql(SQL_POINTS, SQL_RING)
    + """SELECT point_id AS place_id, count(lat1) % 2 = 1 AS inside
FROM points p LEFT JOIN edges e ON (e.lat1 > p.lat) <> (e.lat2 > p.lat)
 AND p.lon < e.lon1 + (p.lat - e.lat1) / (e.lat2 - e.lat1) * (e.lon2 - e.lon1)
GROUP BY point_id""",
)
def j8_point_in_ring(spark, sf):
    pts = points(spark, sf).withColumnRenamed("point_id", "place_id")
    return spatial.point_in_ring(pts, edges_of_ring(spark, sample_ring()))


@query(
    "j9_station_points",
    with_sql(SQL_STATIONS)
    + f""", prefixes AS (SELECT DISTINCT left(p_brand, 7) AS line_prefix FROM part
   UNION SELECT DISTINCT left(p_type, 3) FROM part UNION SELECT 'метро')
SELECT DISTINCT line_prefix, s.ord, s.name, round(lat, 4) AS lat, round(lon, 4) AS lon
FROM stations s, prefixes, unnest(string_split(s.line, '/')) AS t(part)
WHERE lat IS NOT NULL AND (line_prefix = 'метро'
  OR starts_with({sql_key('part')}, {sql_key('line_prefix')}))""",
)
def j9_station_points(spark, sf):
    part = table(spark, sf, "part")
    prefixes = (
        part.select(F.left("p_brand", F.lit(7)).alias("line_prefix"))
        .union(part.select(F.left("p_type", F.lit(3))))
        .distinct()
        .union(spark.createDataFrame([(spatial.ANY_STATION,)], "line_prefix string"))
    )
    out = spatial.station_points(stations(spark, sf), prefixes)
    return out.select("line_prefix", "ord", "name", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query(
    "w10_is_center",
    with_sql(SQL_POINTS)
    + f"""SELECT point_id, {sql_hav('55.75222', '37.61556', 'lat', 'lon')} <= 5000.0 AS is_center
FROM points""",
)
def w10_is_center(spark, sf):
    return points(spark, sf).select("point_id", is_center(F.col("lat"), F.col("lon")).alias("is_center"))
