"""Shortlist operators: customers ask, suppliers are places, parts are stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishgrid.operators import shortlist as ops
from wishgrid.queries.base import SQL_PLACES, lat_of, lon_of, places, sql_hav, sql_lat, sql_lon, table, with_sql
from wishgrid.queries.poi import SQL_MATCHED, SQL_RECORDS, SQL_REQS, matched, poi_records, requirements
from wishgrid.queries.registry import query

D = sql_hav("p.lat", "p.lon", "a.lat", "a.lon")


def _k(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))


def landmarks(spark, sf):
    """Every third customer has a landmark, every sixth two."""
    one = _k(spark, sf).where("k % 3 = 0").select(
        F.col("k").alias("query_id"), lat_of(F.col("k") * 3).alias("lat"), lon_of(F.col("k") * 3).alias("lon"),
        F.expr("case when k % 5 = 0 then 20000 end").alias("max_distance_m"), F.expr("k % 4 = 0").alias("nearest_only"),
    )
    two = _k(spark, sf).where("k % 6 = 0").select(
        F.col("k").alias("query_id"), lat_of(F.col("k") * 7 + 5).alias("lat"), lon_of(F.col("k") * 7 + 5).alias("lon"),
        F.expr("case when k % 10 = 0 then 15000 end").alias("max_distance_m"), F.expr("k % 8 = 0").alias("nearest_only"),
    )
    return one.unionByName(two)


SQL_LANDMARKS = f"""landmarks AS (
  SELECT k AS query_id, {sql_lat('(k * 3)')} AS lat, {sql_lon('(k * 3)')} AS lon, CASE WHEN k % 5 = 0 THEN 20000 END AS max_distance_m, k % 4 = 0 AS nearest_only
  FROM (SELECT c_custkey AS k FROM customer) WHERE k % 3 = 0
  UNION ALL SELECT k, {sql_lat('(k * 7 + 5)')}, {sql_lon('(k * 7 + 5)')}, CASE WHEN k % 10 = 0 THEN 15000 END, k % 8 = 0
  FROM (SELECT c_custkey AS k FROM customer) WHERE k % 6 = 0)"""


def candidates(spark, sf):
    """The suppliers of a customer's orders."""
    spot = places(spark, sf).select("ord", "place_id", "lat", "lon", "district")
    return matched(spark, sf).join(spot, "ord")


SQL_CANDIDATES = "cand AS (SELECT m.*, p.place_id, p.lat, p.lon, p.district FROM matched m JOIN places p USING (ord))"


def anchors(spark, sf):
    """Located requested stations: customers with an even key name one."""
    return _k(spark, sf).where("k % 2 = 0").select(
        F.col("k").alias("query_id"), lat_of(F.col("k") * 11 + 2).alias("lat"), lon_of(F.col("k") * 11 + 2).alias("lon")
    )


SQL_ANCHORS = f"anchors AS (SELECT k AS query_id, {sql_lat('(k * 11 + 2)')} AS lat, {sql_lon('(k * 11 + 2)')} AS lon FROM (SELECT c_custkey AS k FROM customer) WHERE k % 2 = 0)"


@query(
    "w2_homonym_split",
    with_sql(SQL_PLACES, SQL_MATCHED, SQL_CANDIDATES, SQL_ANCHORS)
    + f"""SELECT p.query_id, p.place_id, coalesce(min({D}) > 30000, false) AS homonym
FROM cand p LEFT JOIN anchors a ON a.query_id = p.query_id GROUP BY p.query_id, p.place_id""",
)
def w2_homonym_split(spark, sf):
    out = ops.homonym_split(candidates(spark, sf), anchors(spark, sf), 30000.0)
    return out.select("query_id", "place_id", "homonym")


SQL_LM_DIST = f"""dist AS (SELECT p.query_id, p.place_id, p.ord, min({D}) AS d FROM cand p LEFT JOIN landmarks a ON a.query_id = p.query_id GROUP BY ALL),
maxi AS (SELECT query_id, min(max_distance_m) AS max_m, bool_and(nearest_only) AS pure FROM landmarks GROUP BY query_id)"""


@query(
    "w4_rank_by_landmark",
    with_sql(SQL_PLACES, SQL_MATCHED, SQL_CANDIDATES, SQL_LANDMARKS, SQL_LM_DIST)
    + """SELECT query_id, place_id, round(d, 1) AS dist_m, row_number() OVER (PARTITION BY query_id ORDER BY d NULLS LAST, ord) AS rank
FROM dist LEFT JOIN maxi m USING (query_id) WHERE m.query_id IS NULL OR max_m IS NULL OR d <= max_m""",
)
def w4_rank_by_landmark(spark, sf):
    lm = landmarks(spark, sf)
    out = ops.rank_by_points(candidates(spark, sf), lm, ops.declared_maximum(lm))
    return out.selectExpr("query_id", "place_id", "round(dist_m, 1) as dist_m", "cast(rank as bigint) as rank")


@query(
    "w5_nearest_superlative",
    with_sql(SQL_PLACES, SQL_MATCHED, SQL_CANDIDATES, SQL_LANDMARKS, SQL_LM_DIST)
    + """SELECT * FROM (SELECT query_id, place_id, round(d, 1) AS dist_m, row_number() OVER (PARTITION BY query_id ORDER BY d, ord) AS rank
FROM dist JOIN maxi USING (query_id) WHERE pure AND d IS NOT NULL AND (max_m IS NULL OR d <= max_m)) WHERE rank <= 3""",
)
def w5_nearest_superlative(spark, sf):
    out = ops.nearest_superlative(candidates(spark, sf), landmarks(spark, sf))
    return out.selectExpr("query_id", "place_id", "round(dist_m, 1) as dist_m", "cast(rank as bigint) as rank")


@query(
    "w5_mixed_superlatives",
    with_sql(SQL_LANDMARKS)
    + "SELECT query_id FROM landmarks GROUP BY query_id HAVING bool_or(nearest_only) AND NOT bool_and(nearest_only)",
)
def w5_mixed_superlatives(spark, sf):
    return ops.mixed_superlatives(landmarks(spark, sf))


@query(
    "w6_nearest_fallback",
    with_sql(SQL_PLACES, SQL_MATCHED, SQL_CANDIDATES, SQL_LANDMARKS, SQL_LM_DIST)
    + """SELECT query_id, place_id, round(d, 1) AS dist_m, round(nearest, 1) AS nearest_m, rank FROM (
 SELECT query_id, place_id, d, min(d) OVER (PARTITION BY query_id) AS nearest,
   row_number() OVER (PARTITION BY query_id ORDER BY d, ord) AS rank FROM dist WHERE d IS NOT NULL)
JOIN maxi USING (query_id) WHERE max_m IS NULL AND nearest > 5000 AND rank <= 8""",
)
def w6_nearest_fallback(spark, sf):
    lm = landmarks(spark, sf)
    out = ops.nearest_fallback(candidates(spark, sf), lm, ops.declared_maximum(lm), ops.LANDMARK_RADIUS_M)
    return out.selectExpr(
        "query_id", "place_id", "round(dist_m, 1) as dist_m", "round(nearest_m, 1) as nearest_m", "cast(rank as bigint) as rank"
    )


# --- W1: ids for every 11th customer, names for every 4th, the rest unrestricted -------------------


def _wanted_ids(spark, sf):
    return _k(spark, sf).where("k % 11 = 0").selectExpr("k as query_id", "explode(array(concat('b', k % 97), concat('b', k % 89))) as place_id")


def _wanted_names(spark, sf):
    return _k(spark, sf).where("k % 4 <= 1").selectExpr(
        "k as query_id", "case when k % 8 = 0 then 'Nowhere' when k % 8 = 1 then concat('NATION_', k % 25) else concat('nation_', k % 5) end as name"
    )


SQL_WANTED = """ids AS (SELECT DISTINCT k AS query_id, unnest(['b' || (k % 97), 'b' || (k % 89)]) AS place_id FROM (SELECT c_custkey AS k FROM customer) WHERE k % 11 = 0),
names AS (SELECT k AS query_id, CASE WHEN k % 8 = 0 THEN 'Nowhere' WHEN k % 8 = 1 THEN 'NATION_' || (k % 25) ELSE 'nation_' || (k % 5) END AS name
  FROM (SELECT c_custkey AS k FROM customer) WHERE k % 4 <= 1)"""

SQL_SHORTLIST = f"""q AS (SELECT c_custkey AS query_id, c_custkey IN (SELECT query_id FROM landmarks) AS ranked,
  c_custkey IN (SELECT query_id FROM ids) AS has_ids, c_custkey IN (SELECT query_id FROM names) AS has_names,
  c_custkey IN (SELECT query_id FROM anchors) AS anchored FROM customer),
lmd AS (SELECT a.query_id, p.ord, min({D}) AS d FROM landmarks a CROSS JOIN places p WHERE p.lat IS NOT NULL GROUP BY ALL),
ad AS (SELECT a.query_id, p.ord, min({D}) AS d FROM anchors a CROSS JOIN places p WHERE p.lat IS NOT NULL GROUP BY ALL),
maxi AS (SELECT query_id, min(max_distance_m) AS max_m FROM landmarks GROUP BY query_id),
tagged AS (SELECT DISTINCT q.query_id, q.ranked, p.ord FROM q JOIN names n USING (query_id)
  JOIN places p ON lower(n.name) IN (lower(p.district), lower(p.county), lower(p.metro)) WHERE NOT q.has_ids),
cut AS (SELECT * FROM tagged QUALIFY ranked OR row_number() OVER (PARTITION BY query_id ORDER BY ord) <= 50),
plausible AS (SELECT c.query_id, c.ord FROM cut c LEFT JOIN ad USING (query_id, ord) WHERE coalesce(ad.d <= 30000, true)),
lost AS (SELECT * FROM q WHERE has_names AND NOT has_ids AND query_id NOT IN (SELECT query_id FROM plausible)),
pool AS (
  SELECT query_id, p.ord, 'ids' AS source, ranked AS by_lm, false AS by_anchor FROM q JOIN ids USING (query_id) JOIN places p USING (place_id)
  UNION ALL SELECT query_id, ord, 'names', ranked, false FROM plausible JOIN q USING (query_id)
  UNION ALL SELECT l.query_id, ad.ord, 'region', false, true FROM lost l JOIN ad USING (query_id) WHERE NOT ranked AND ad.d <= 30000
  UNION ALL SELECT l.query_id, p.ord, 'city', false, false FROM lost l CROSS JOIN places p WHERE NOT ranked AND NOT anchored
  UNION ALL SELECT l.query_id, p.ord, CASE WHEN anchored AND p.lat IS NOT NULL THEN 'city' ELSE 'all' END, true, false FROM lost l CROSS JOIN places p LEFT JOIN ad USING (query_id, ord) WHERE ranked AND coalesce(ad.d <= 30000, true)
  UNION ALL SELECT q.query_id, p.ord, 'all', ranked, false FROM q CROSS JOIN places p WHERE NOT has_ids AND NOT has_names),
scored AS (SELECT pool.*, CASE WHEN by_lm THEN lmd.d WHEN by_anchor THEN ad.d END AS d, max_m FROM pool
  LEFT JOIN lmd USING (query_id, ord) LEFT JOIN ad USING (query_id, ord) LEFT JOIN maxi USING (query_id)
  WHERE NOT by_lm OR max_m IS NULL OR lmd.d <= max_m)"""


@query(
    "w1_shortlist",
    with_sql(SQL_PLACES, SQL_LANDMARKS, SQL_ANCHORS, SQL_WANTED, SQL_SHORTLIST)
    + """SELECT * FROM (SELECT query_id, ord, source, round(d, 1) AS dist_m,
   row_number() OVER (PARTITION BY query_id ORDER BY d NULLS LAST, ord) AS rank FROM scored) WHERE rank <= 50""",
)
def w1_shortlist(spark, sf):
    lm = landmarks(spark, sf)
    ranked = lm.select("query_id").distinct().withColumn("ranked", F.lit(True))
    queries = _k(spark, sf).selectExpr("k as query_id").join(ranked, "query_id", "left").na.fill(False, ["ranked"])
    out = ops.shortlist(
        queries, places(spark, sf), _wanted_ids(spark, sf), _wanted_names(spark, sf), anchors(spark, sf),
        lm.select("query_id", "lat", "lon"), ops.declared_maximum(lm), anchor_radius_m=30000.0,
    )
    return out.selectExpr("query_id", "ord", "source", "round(dist_m, 1) as dist_m", "cast(rank as bigint) as rank")


@query(
    "w3_fallback_notes",
    with_sql(SQL_PLACES, SQL_ANCHORS)
    + f"""SELECT a.query_id, count_if({D} > 30000) AS other_region, count_if(p.lat IS NULL) AS unlocatable,
 round(min(CASE WHEN {D} <= 30000 THEN {D} END), 1) AS nearest_m FROM anchors a CROSS JOIN places p GROUP BY a.query_id""",
)
def w3_fallback_notes(spark, sf):
    rows = anchors(spark, sf)
    out = ops.fallback_notes(rows.select("query_id"), places(spark, sf), rows, 30000.0)
    return out.withColumn("nearest_m", F.round("nearest_m", 1))


# --- narrowing ----------------------------------------------------------------------------------


def _criteria(spark, sf):
    return _k(spark, sf).selectExpr("k as query_id", "k % 9 = 4 as center_requested")


def _classes(spark, sf):
    return _k(spark, sf).where("k % 5 = 1").selectExpr("k as query_id", "'x' as line_prefix", "case when k % 2 = 0 then 9000 end as max_distance_m")


def _class_points(spark, sf):
    return _k(spark, sf).where("k % 5 = 1 and k % 7 <> 0").select(
        F.col("k").alias("query_id"), lat_of(F.col("k") * 13 + 4).alias("lat"), lon_of(F.col("k") * 13 + 4).alias("lon")
    )


def _centred(spark, sf):
    return candidates(spark, sf).withColumn("is_center", F.expr("case when ord % 6 < 5 then ord % 6 = 1 end"))


SQL_NARROW = f"""crit AS (SELECT c_custkey AS query_id, c_custkey % 9 = 4 AS center_requested FROM customer),
classes AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN 9000 END AS max_distance_m FROM customer WHERE c_custkey % 5 = 1),
cpoints AS (SELECT k AS query_id, {sql_lat('(k * 13 + 4)')} AS lat, {sql_lon('(k * 13 + 4)')} AS lon FROM (SELECT c_custkey AS k FROM customer) WHERE k % 5 = 1 AND k % 7 <> 0),
cc AS (SELECT *, CASE WHEN ord % 6 < 5 THEN ord % 6 = 1 END AS is_center FROM cand),
checked AS (SELECT * FROM reqs WHERE category IN (SELECT category FROM poi)),
poi_ok AS (SELECT c.query_id, c.place_id, bool_and(coalesce(CASE WHEN schema_version >= 2 THEN count_operational > 0 ELSE count > 0 END, false)
   AND (max_distance_m IS NULL OR coalesce(closest_distance_m <= max_distance_m, false))) AS ok
  FROM cc c JOIN checked r USING (query_id) LEFT JOIN poi USING (slug, category) GROUP BY ALL),
ld AS (SELECT p.query_id, p.place_id, min({D}) AS d FROM cand p JOIN landmarks a ON a.query_id = p.query_id GROUP BY ALL),
sd AS (SELECT p.query_id, p.place_id, min({D}) AS d FROM cand p JOIN cpoints a ON a.query_id = p.query_id GROUP BY ALL),
lr AS (SELECT query_id, coalesce(min(max_distance_m), 5000) AS r FROM landmarks GROUP BY query_id),
sr AS (SELECT query_id, coalesce(min(max_distance_m), 1500) AS r FROM classes GROUP BY query_id)"""
SQL_NARROW_BASE = with_sql(SQL_PLACES, SQL_MATCHED, SQL_CANDIDATES, SQL_LANDMARKS, SQL_RECORDS, SQL_REQS, SQL_NARROW)


@query(
    "w7_narrow",
    SQL_NARROW_BASE
    + """SELECT c.query_id, c.place_id, coalesce(ok, true) AND (NOT center_requested OR coalesce(is_center, false))
  AND (lr.r IS NULL OR coalesce(ld.d <= lr.r, false)) AND (sr.r IS NULL OR coalesce(sd.d <= sr.r, false)) AS satisfies,
  c.query_id IN (SELECT query_id FROM checked) OR center_requested OR lr.r IS NOT NULL OR sr.r IS NOT NULL AS narrowing
FROM cc c JOIN crit USING (query_id) LEFT JOIN poi_ok USING (query_id, place_id) LEFT JOIN ld USING (query_id, place_id)
LEFT JOIN sd USING (query_id, place_id) LEFT JOIN lr USING (query_id) LEFT JOIN sr USING (query_id)""",
)
def w7_narrow(spark, sf):
    return ops.narrow(
        _criteria(spark, sf), _centred(spark, sf), requirements(spark, sf), poi_records(spark, sf),
        landmarks(spark, sf), _classes(spark, sf), _class_points(spark, sf),
    )


@query(
    "w8_fully_resolved",
    SQL_NARROW_BASE
    + """SELECT q.query_id, (NOT center_requested OR NOT EXISTS (SELECT 1 FROM cc WHERE cc.query_id = q.query_id AND is_center IS NULL))
  AND NOT EXISTS (SELECT 1 FROM reqs WHERE reqs.query_id = q.query_id AND only_new)
  AND NOT EXISTS (SELECT 1 FROM cc JOIN reqs r USING (query_id) WHERE cc.query_id = q.query_id
     AND NOT EXISTS (SELECT 1 FROM poi WHERE poi.slug = cc.slug AND poi.category = r.category))
  AND (q.query_id NOT IN (SELECT query_id FROM landmarks) OR NOT EXISTS (SELECT 1 FROM cc WHERE cc.query_id = q.query_id AND lat IS NULL))
  AND (q.query_id NOT IN (SELECT query_id FROM classes) OR (q.query_id IN (SELECT query_id FROM cpoints)
     AND NOT EXISTS (SELECT 1 FROM cc WHERE cc.query_id = q.query_id AND lat IS NULL))) AS resolved FROM crit q""",
)
def w8_fully_resolved(spark, sf):
    return ops.fully_resolved(
        _criteria(spark, sf), _centred(spark, sf), requirements(spark, sf), poi_records(spark, sf),
        landmarks(spark, sf), _classes(spark, sf), _class_points(spark, sf),
    )
