"""Answers, merges, routes and small predicates over customers, orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishgrid.functions.text import normalize_key
from wishgrid.operators import answers as ops
from wishgrid.operators import routes
from wishgrid.operators.catalog import by_tag
from wishgrid.operators.spatial import point_in_ring, radius_or_nearest
from wishgrid.queries.base import SQL_PLACES, places, sql_hav, sql_key, stations, table, with_sql
from wishgrid.queries.geo import SQL_RING
from wishgrid.queries.registry import query
from wishgrid.session import fixed_table
from wishgrid.sources.ring import edges_of_ring, sample_ring


@query("p1_normalize_key", f"SELECT doc_id, md5({sql_key('text')}) AS key_md5 FROM documents")
def p1_normalize_key(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(normalize_key("text")).alias("key_md5"))


SEVERITY = {  # fixed values
    "lost": "error", "unknown": "error", "degraded": "warning", "capped": "warning",
    "unverified": "info", "noise": "info", "info": "info",
}


@query(
    "p9_warning_severity",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'warning' ELSE 'error' END AS severity FROM events""",
)
def p9_warning_severity(spark, sf):
    dim = fixed_table(spark, list(SEVERITY.items()), "category string, severity string")
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "case event_type when 'view' then 'noise' when 'click' then 'capped' when 'error' then 'lost' else 'odd' end as category"
    )
    return rows.join(dim, "category", "left").select("event_id", F.coalesce("severity", F.lit("error")).alias("severity"))


@query(
    "p11_travel_mode",
    """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'driving' ELSE 'transit' END
 WHEN o_orderkey % 7 = 0 THEN 'pedestrian' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'driving' WHEN 1 THEN 'transit' WHEN 2 THEN 'bicycle' ELSE 'pedestrian' END END AS mode FROM orders""",
)
def p11_travel_mode(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id",
        "case o_orderkey % 4 when 0 then 'Ехать на Машине' when 1 then 'на транспорте' when 2 then 'велосипед' else 'рядом' end as text",
        "case when o_orderkey % 5 = 0 then 10 end as time_on_transport", "case when o_orderkey % 7 = 0 then 5 end as time_on_foot",
    )
    return rows.select("query_id", routes.travel_mode().alias("mode"))


@query(
    "p12_zoom_band",
    """SELECT o_orderkey AS id, CASE WHEN d < 1500 THEN 15 WHEN d < 4000 THEN 14 WHEN d < 10000 THEN 12 WHEN d < 25000 THEN 11 ELSE 10 END AS zoom
FROM (SELECT o_orderkey, o_totalprice / 10 AS d FROM orders)""",
)
def p12_zoom_band(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_totalprice / 10 as distance_m")
    return rows.select("id", routes.zoom_band().alias("zoom"))


@query(
    "p13_query_signature",
    f"""SELECT o_orderkey AS query_id, 'wish ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' | poi=' || CASE WHEN o_orderkey % 4 = 0
  THEN 'bank,school:new:d' || (o_custkey % 90) ELSE 'bank' END ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' | center=1' ELSE '' END
 || CASE WHEN o_orderkey % 5 = 0 THEN ' | landmark=' || {sql_key("'Zz  Y'")} || ',' || {sql_key("'Aa ' || o_custkey")} ELSE '' END AS signature FROM orders""",
)
def p13_query_signature(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id", "concat('  Wish ', o_custkey, ' ') as text",
        """case when o_orderkey % 4 = 0 then array(named_struct('category', 'school', 'only_new', true, 'max_distance_m', o_custkey % 90),
             named_struct('category', 'bank', 'only_new', false, 'max_distance_m', null))
           when o_orderkey % 2 = 0 then array(named_struct('category', 'bank', 'only_new', false, 'max_distance_m', cast(null as bigint)))
           else cast(array() as array<struct<category: string, only_new: boolean, max_distance_m: bigint>>) end as poi""",
        "o_orderkey % 3 = 0 as center_requested",
        "case when o_orderkey % 5 = 0 then array('Zz  Y', concat('Aa ', o_custkey)) else cast(array() as array<string>) end as landmarks",
        "cast(array() as array<string>) as classes",
    )
    return rows.selectExpr("query_id", f"{ops.query_signature()} as signature")


# --- routes -----------------------------------------------------------------------------------

D = sql_hav("lat1", "lon1", "lat2", "lon2")
SQL_TRIPS = f"""trips AS (SELECT o_orderkey AS query_id, l_linenumber AS n, p.ord, p.lat AS lat1, p.lon AS lon1, 55.4 + (o_custkey % 600) / 1000.0 AS lat2, 37.0 + (o_custkey % 900) / 1000.0 AS lon2,
  CASE o_orderkey % 4 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'driving' WHEN 2 THEN 'transit' ELSE 'bicycle' END AS mode, CASE WHEN o_orderkey % 3 = 0 THEN 60 END AS max_min
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN places p ON p.ord = l_suppkey WHERE p.lat IS NOT NULL),
legs AS (SELECT *, {D} * CASE mode WHEN 'pedestrian' THEN 1.25 WHEN 'driving' THEN 1.35 WHEN 'transit' THEN 1.3 ELSE 1.2 END AS distance_m FROM trips),
timed AS (SELECT *, greatest(1, round_even(distance_m / CASE mode WHEN 'pedestrian' THEN 83.33 WHEN 'driving' THEN 500.0 WHEN 'transit' THEN 333.33 ELSE 250.0 END
  + CASE mode WHEN 'transit' THEN 3 ELSE 0 END, 0))::INT AS duration_min FROM legs)"""


def _trips(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("ord"))
    spots = places(spark, sf).where("lat is not null").select("ord", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    return (
        table(spark, sf, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(spots, "ord")
        .selectExpr(
            "o_orderkey as query_id", "l_linenumber as n", "ord", "lat1", "lon1", "55.4D + (o_custkey % 600) / 1000.0D as lat2",
            "37.0D + (o_custkey % 900) / 1000.0D as lon2",
            "case o_orderkey % 4 when 0 then 'pedestrian' when 1 then 'driving' when 2 then 'transit' else 'bicycle' end as mode",
            "case when o_orderkey % 3 = 0 then 60 end as max_min",
        )
    )


@query("w12_travel_estimate", with_sql(SQL_PLACES, SQL_TRIPS) + "SELECT query_id, ord, mode, round(distance_m, 0) AS distance_m, duration_min FROM timed")
def w12_travel_estimate(spark, sf):
    out = routes.travel_estimate(_trips(spark, sf))
    return out.selectExpr("query_id", "ord", "mode", "round(distance_m, 0) as distance_m", "duration_min")


@query(
    "w13_best_route",
    with_sql(SQL_PLACES, SQL_TRIPS)
    + """SELECT * FROM (SELECT query_id, duration_min, row_number() OVER (PARTITION BY query_id ORDER BY duration_min, ord) AS rank,
 max_min IS NULL OR duration_min <= max_min AS within_limit FROM timed) WHERE rank <= 10""",
)
def w13_best_route(spark, sf):
    out = routes.best_route(routes.travel_estimate(_trips(spark, sf)))
    return out.selectExpr("query_id", "duration_min", "cast(rank as bigint) as rank", "within_limit")


@query(
    "j21_destination",
    with_sql("st AS (SELECT p_partkey AS ord, lower(p_name || ' ' || p_size) AS k, p_partkey % 29 <> 3 AS located FROM part)")
    + f""", lm AS (SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey % 5 = 0),
req AS (SELECT o_orderkey AS query_id, lower(p_name || ' ' || p_size) AS k FROM orders JOIN part ON p_partkey = o_custkey WHERE o_orderkey % 3 = 0),
first AS (SELECT k, min(ord) AS ord FROM st GROUP BY k),
okreq AS (SELECT query_id FROM req JOIN first USING (k) JOIN st USING (ord) WHERE located),
txt AS (SELECT o_orderkey AS query_id, s_suppkey AS ord FROM orders JOIN supplier ON s_suppkey = o_custkey WHERE s_suppkey % 23 <> 7)
SELECT o_orderkey AS query_id, CASE WHEN o_orderkey IN (SELECT query_id FROM lm) THEN 0 WHEN o_orderkey IN (SELECT query_id FROM okreq) THEN 1
 WHEN o_orderkey IN (SELECT query_id FROM txt) THEN 2 ELSE 3 END AS prio FROM orders
WHERE o_orderkey % 2 = 0 OR o_orderkey IN (SELECT query_id FROM lm) OR o_orderkey IN (SELECT query_id FROM okreq) OR o_orderkey IN (SELECT query_id FROM txt)""",
)
def j21_destination(spark, sf):
    orders = table(spark, sf, "orders")
    none = F.expr("cast(array() as array<string>)")
    criteria = orders.selectExpr(
        "o_orderkey as query_id", "concat('near ', 'SUPPLIER#', lpad(o_custkey, 9, '0'), ' please') as text", "o_orderkey % 2 = 0 as center_requested"
    )
    lm = orders.where("o_orderkey % 5 = 0").selectExpr("o_orderkey as query_id", "0 as pos", "'x' as name", "55.0D as lat", "37.0D as lon")
    requested = orders.where("o_orderkey % 3 = 0").join(
        table(spark, sf, "part"), F.col("p_partkey") == F.col("o_custkey")
    ).selectExpr("o_orderkey as query_id", "0 as pos", "concat_ws(' ', p_name, p_size) as name")
    catalog = places(spark, sf).select("ord", "name", "lat", "lon").withColumn("aliases", none)
    out = routes.destination(criteria, lm, requested, stations(spark, sf).withColumn("aliases", none), catalog)
    return out.select("query_id", "prio")


@query(
    "j23_origins",
    """WITH own AS (SELECT c_custkey AS query_id, s_suppkey AS ord FROM customer JOIN supplier ON s_suppkey = c_custkey % 500 WHERE c_custkey % 2 = 0 AND s_suppkey % 23 <> 7)
SELECT query_id, ord, false AS fallback FROM own UNION ALL
SELECT c_custkey, s_suppkey, true FROM customer, supplier WHERE s_suppkey % 23 <> 7 AND c_custkey NOT IN (SELECT query_id FROM own)""",
)
def j23_origins(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_custkey as query_id", "concat('Supplier#', lpad(c_custkey % 500, 9, '0')) as name")
    cat = places(spark, sf).select("ord", "name", "lat", "lon").withColumn("aliases", F.expr("cast(array() as array<string>)"))
    return routes.origins(customers.select("query_id"), customers.where("query_id % 2 = 0"), cat)


# --- answers ------------------------------------------------------------------------------------


@query(
    "j14_shortlist_semi",
    with_sql(SQL_PLACES)
    + """, ans AS (SELECT o_orderkey AS query_id, 'complex' AS kind, 'b' || (o_custkey % 100) AS value FROM orders
 UNION ALL SELECT o_orderkey, 'district', 'NATION_' || (o_custkey % 25) FROM orders),
offer AS (SELECT l_orderkey AS query_id, place_id, district FROM lineitem JOIN places ON ord = l_suppkey)
SELECT query_id, kind, value FROM ans a WHERE EXISTS (SELECT 1 FROM offer o WHERE o.query_id = a.query_id AND a.value = CASE kind WHEN 'complex' THEN place_id ELSE district END)""",
)
def j14_shortlist_semi(spark, sf):
    orders = table(spark, sf, "orders")
    answers = orders.selectExpr("o_orderkey as query_id", "'complex' as kind", "concat('b', o_custkey % 100) as value").unionByName(
        orders.selectExpr("o_orderkey as query_id", "'district' as kind", "concat('NATION_', o_custkey % 25) as value")
    )
    offer = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("ord")).join(
        places(spark, sf).select("ord", "place_id", "district"), "ord"
    )
    return ops.shortlist_semi(answers, offer)


@query(
    "j15_known_slugs_semi",
    f"""SELECT o_custkey AS query_id, {sql_key("'Phrase  ' || (o_orderkey % 10)")} AS phrase_key, 's' || (o_orderkey % 3000) AS slug,
 max(CASE WHEN o_orderkey % 3000 % 2 = 0 THEN 'option_group' ELSE 'option' END) AS subject_type, arg_min(o_orderkey, o_orderkey) AS pos
FROM orders WHERE o_orderkey % 3000 IN (SELECT p_partkey FROM part) GROUP BY ALL""",
)
def j15_known_slugs_semi(spark, sf):
    answers = table(spark, sf, "orders").selectExpr(
        "o_custkey as query_id", "o_orderkey as pos", "concat('Phrase  ', o_orderkey % 10) as phrase",
        "concat('s', o_orderkey % 3000) as slug", "o_orderkey as confidence",
    )
    part = table(spark, sf, "part")
    groups = part.where("p_partkey % 2 = 0").selectExpr("concat('s', p_partkey) as slug")
    options = part.selectExpr("concat('s', p_partkey) as slug")
    out = ops.known_slugs_semi(answers, groups, options)
    return out.selectExpr("query_id", "phrase_key", "slug", "subject_type", "confidence as pos")


SQL_LEFT = "residual AS (SELECT DISTINCT o_custkey AS query_id, 'p' || (o_orderkey % 3) AS phrase FROM orders WHERE o_orderstatus <> 'F')"


def _residuals(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus <> 'F'").selectExpr("o_custkey as query_id", "concat('p', o_orderkey % 3) as phrase")


@query(
    "j16_resolve_landmarks",
    with_sql(SQL_PLACES, SQL_LEFT)
    + """SELECT o_custkey AS query_id, p.name, min(o_orderkey) AS pos FROM orders JOIN places p ON p.ord = o_orderkey % 150 JOIN residual r ON r.query_id = o_custkey AND r.phrase = 'p' || (o_orderkey % 4)
WHERE p.lat IS NOT NULL GROUP BY ALL""",
)
def j16_resolve_landmarks(spark, sf):
    answers = table(spark, sf, "orders").selectExpr(
        "o_custkey as query_id", "o_orderkey as pos", "concat('p', o_orderkey % 4) as phrase", "concat('c', o_orderkey % 150) as slug"
    )
    landmarks = places(spark, sf).withColumn("category", F.lit("x"))
    return ops.resolve_landmarks(answers, landmarks, _residuals(spark, sf)).select("query_id", "name", "pos")


@query(
    "j17_resolve_finish",
    with_sql(SQL_LEFT)
    + """SELECT o_custkey AS query_id, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 5 END::INT AS finish, min(o_orderkey) AS pos FROM orders
JOIN residual r ON r.query_id = o_custkey AND r.phrase = 'p' || (o_orderkey % 4) WHERE o_orderkey % 5 < 4 GROUP BY ALL""",
)
def j17_resolve_finish(spark, sf):
    answers = table(spark, sf, "orders").selectExpr(
        "o_custkey as query_id", "o_orderkey as pos", "concat('p', o_orderkey % 4) as phrase", "cast(case when o_orderkey % 5 < 4 then o_orderkey % 5 end as int) as finish"
    )
    return ops.resolve_finish(answers, _residuals(spark, sf))


@query(
    "j17_resolve_poi",
    with_sql(SQL_LEFT)
    + """, a AS (SELECT o_custkey AS query_id, o_orderkey AS pos, 'p' || (o_orderkey % 4) AS phrase, ['school', 'other', 'bank'][(o_orderkey % 3 + 1)::INT] AS category, o_orderkey % 4000 - 5 AS m FROM orders)
SELECT query_id, category, arg_min(CASE WHEN m > 0 AND m <= 2000 THEN {'m': m} ELSE {'m': NULL} END, pos).m AS max_distance_m, min(pos) AS pos FROM a
JOIN residual r USING (query_id, phrase) WHERE category <> 'other' GROUP BY ALL""",
)
def j17_resolve_poi(spark, sf):
    answers = table(spark, sf, "orders").selectExpr(
        "o_custkey as query_id", "o_orderkey as pos", "concat('p', o_orderkey % 4) as phrase",
        "element_at(array('school', 'other', 'bank'), cast(o_orderkey % 3 + 1 as int)) as category",
        "o_orderkey % 4000 - 5 as max_distance_m", "false as only_new",
    )
    return ops.resolve_poi(answers, _residuals(spark, sf)).select("query_id", "category", "max_distance_m", "pos")


SQL_BLOCKS = """g AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 4 = 0 THEN []::BIGINT[] ELSE [o_custkey % 7, o_custkey % 5, 3] END AS existing,
  CASE WHEN o_orderkey % 9 = 0 THEN [100] ELSE [o_orderkey % 7, o_orderkey % 5, o_orderkey % 5] END AS fallback FROM orders)"""


@query(
    "u1_combine_blocks",
    with_sql(SQL_BLOCKS)
    + """SELECT query_id, array_to_string(list_sort(CASE WHEN len(existing) = 0 THEN list_distinct(fallback) WHEN len(list_intersect(existing, fallback)) = 0
 THEN list_distinct(existing) ELSE list_distinct(list_intersect(existing, fallback)) END), ',') AS combined,
 CASE WHEN len(existing) > 0 AND len(list_intersect(existing, fallback)) = 0 THEN 'no_intersection' END AS note FROM g""",
)
def u1_combine_blocks(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id",
        "case when o_orderkey % 4 = 0 then cast(array() as array<bigint>) else array(o_custkey % 7, o_custkey % 5, 3L) end as existing",
        "case when o_orderkey % 9 = 0 then array(100L) else array(o_orderkey % 7, o_orderkey % 5, o_orderkey % 5) end as fallback",
    )
    out = ops.combine_blocks(rows)
    return out.selectExpr("query_id", "array_join(transform(array_sort(combined), x -> cast(x as string)), ',') as combined", "note")


SQL_FALLBACK = f"""crit AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' || (c_custkey % 25) END AS district,
  CASE WHEN c_custkey % 7 = 0 THEN 'nation_77' WHEN c_custkey % 4 = 1 THEN 'ASIA' END AS county,
  CASE WHEN c_custkey % 5 = 0 THEN true WHEN c_custkey % 5 = 1 THEN false END AS within FROM customer),
ring AS (SELECT p.place_id, count(e.lat1) % 2 = 1 AS inside FROM places p LEFT JOIN edges e ON (e.lat1 > p.lat) <> (e.lat2 > p.lat)
  AND p.lon < e.lon1 + (p.lat - e.lat1) / (e.lat2 - e.lat1) * (e.lon2 - e.lon1) WHERE p.lat IS NOT NULL GROUP BY p.place_id),
stn AS (SELECT c_custkey AS query_id, 55.4 + (c_custkey * 37 % 650) / 1000.0 AS lat, 36.7 + (c_custkey * 53 % 1600) / 1000.0 AS lon FROM customer WHERE c_custkey % 8 = 3),
sd AS (SELECT s.query_id, p.place_id, {sql_hav('s.lat', 's.lon', 'p.lat', 'p.lon')} AS d, p.ord FROM stn s CROSS JOIN places p WHERE p.lat IS NOT NULL),
near AS (SELECT query_id, place_id FROM (SELECT *, min(d) OVER (PARTITION BY query_id) AS m, row_number() OVER (PARTITION BY query_id ORDER BY d, ord) AS rn FROM sd)
  WHERE d <= 1500 OR (m > 1500 AND rn <= 8)),
steps AS (SELECT query_id, place_id FROM near UNION SELECT query_id, place_id FROM crit JOIN places p ON p.county = crit.county
  UNION SELECT query_id, place_id FROM crit JOIN places p ON p.district = crit.district)"""


@query(
    "u2_fallback_blocks",
    with_sql(SQL_PLACES, SQL_RING, SQL_FALLBACK)
    + """SELECT s.query_id, s.place_id FROM steps s JOIN crit USING (query_id) LEFT JOIN ring USING (place_id) WHERE within IS NULL OR within = inside
UNION ALL SELECT query_id, place_id FROM crit JOIN ring ON within = inside WHERE query_id NOT IN (SELECT query_id FROM steps)""",
)
def u2_fallback_blocks(spark, sf):
    from wishgrid.queries.base import lat_of, lon_of

    k = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    spots = places(spark, sf)
    near = radius_or_nearest(
        k.where("k % 8 = 3").select(F.col("k").alias("point_id"), lat_of(F.col("k")).alias("lat"), lon_of(F.col("k")).alias("lon")), spots
    ).selectExpr("point_id as query_id", "0 as step", "place_id", "cast(dist_m as double) as ord")
    named = k.selectExpr(
        "k as query_id",
        "stack(2, 1, 'county', case when k % 7 = 0 then 'nation_77' when k % 4 = 1 then 'ASIA' end,"
        " 2, 'district', case when k % 3 = 0 then concat('NATION_', k % 25) end) as (step, field, name)",
    ).where("name is not null")
    tags = by_tag(spots, named.select("field", "name").distinct())
    tags = tags.selectExpr("field", "name", "place_id", "cast(ord as double) as ord")
    sides = k.selectExpr("k as query_id", "case when k % 5 = 0 then true when k % 5 = 1 then false end as within")
    ring = point_in_ring(spots, edges_of_ring(spark, sample_ring()))
    return ops.fallback_blocks(near, sides, ring, named, tags).select("query_id", "place_id")


@query(
    "u3_merge_enrichment",
    """SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 <> 0 THEN '7'
  WHEN c_custkey % 150 IN (SELECT s_suppkey FROM supplier) AND c_custkey % 150 <> 5 THEN (c_custkey % 150) || ',5' ELSE '5' END AS complexes,
 'd0' || CASE WHEN c_custkey % 3 = 0 AND c_custkey % 40 < 25 THEN ',d' || (c_custkey % 40) ELSE '' END AS districts,
 false AS matched_empty FROM customer""",
)
def u3_merge_enrichment(spark, sf):
    k = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    criteria = k.selectExpr("k as query_id", "array('7') as complexes", "array('d0') as districts")
    results = k.selectExpr(
        "k as query_id", "k % 2 = 0 as matched", "array(cast(k % 150 as string), '5', '5') as matched_ids",
        "case when k % 3 = 0 then array(concat('d', k % 40)) else cast(array() as array<string>) end as district_ids",
    )
    complexes = table(spark, sf, "supplier").selectExpr("cast(s_suppkey as string) as id")
    districts = table(spark, sf, "nation").selectExpr("concat('d', n_nationkey) as id")
    out = ops.merge_enrichment(criteria, results, complexes, districts)
    return out.selectExpr("query_id", "array_join(complexes, ',') as complexes", "array_join(districts, ',') as districts", "matched_empty")


@query(
    "u4_fill_missing",
    """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 5 WHEN o_orderkey % 7 >= 2 THEN o_orderkey % 7 - 2 END AS price_min,
 CASE WHEN o_orderkey % 4 = 0 THEN 9 WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS floor_min,
 CASE WHEN o_orderkey % 2 = 0 THEN 'one' ELSE 'two' END AS rooms, o_orderkey % 6 = 0 OR o_orderkey % 10 = 0 AS last_floor,
 array_to_string(list_filter([CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 < 2 THEN 'price_min' END, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 = 0 THEN 'floor_min' END], lambda s: s IS NOT NULL), ',') AS rejected FROM orders""",
)
def u4_fill_missing(spark, sf):
    o = table(spark, sf, "orders")
    criteria = o.selectExpr(
        "o_orderkey as query_id", "case when o_orderkey % 3 = 0 then 5L end as price_min", "case when o_orderkey % 4 = 0 then 9L end as floor_min",
        "case when o_orderkey % 2 = 0 then array('one') else cast(array() as array<string>) end as rooms", "o_orderkey % 6 = 0 as last_floor",
    )
    answers = o.selectExpr(
        "o_orderkey as query_id", "o_orderkey % 7 - 2 as price_min", "o_orderkey % 5 as floor_min", "array('two', 'two') as rooms", "o_orderkey % 10 = 0 as last_floor"
    )
    out = ops.fill_missing(criteria, answers, ["price_min", "floor_min"], ["rooms"], ["last_floor"])
    return out.selectExpr("query_id", "price_min", "floor_min", "array_join(rooms, ',') as rooms", "last_floor", "array_join(rejected, ',') as rejected")


@query(
    "u12_differs",
    "SELECT o_orderkey AS query_id, (o_custkey % 3 <> o_orderkey % 3) OR o_orderkey % 5 = 0 AS differs FROM orders",
)
def u12_differs(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id", "array(o_custkey % 3, o_custkey % 3, 9L) as result_ids", "array(9L, o_orderkey % 3) as known_ids",
        "case when o_orderkey % 5 = 0 then array('d') else cast(array() as array<string>) end as result_districts", "cast(array() as array<string>) as known_districts",
    )
    return ops.differs(rows).select("query_id", "differs")


@query(
    "w14_first_wins",
    """SELECT l_orderkey AS query_id, arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey)) FILTER (l_returnflag <> 'N') AS first_value,
 arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS last_side FROM lineitem GROUP BY l_orderkey""",
)
def w14_first_wins(spark, sf):
    from wishgrid.operators.mentions import first_wins, last_mention

    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as query_id", "named_struct('a', l_linenumber, 'b', l_partkey, 'c', l_suppkey) as pos",
        "case when l_returnflag <> 'N' then l_quantity end as value", "l_returnflag as side",
    )
    return first_wins(lines).join(last_mention(lines), "query_id")
