"""Place-of-interest operators: orders are map elements, suppliers the complexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishgrid.operators import poi as ops
from wishgrid.operators.skew import dealt
from wishgrid.packs.poi_tags import CATEGORY_TAGS
from wishgrid.queries.base import SQL_PLACES, lat_of, lon_of, places, sql_hav, sql_lat, sql_lon, table, with_sql
from wishgrid.queries.registry import query
from wishgrid.session import scratch_path
from wishgrid.sources.catalog import poi_long

AMENITY = """CASE k % 12 WHEN 0 THEN 'school' WHEN 1 THEN 'kindergarten' WHEN 2 THEN 'parking' WHEN 3 THEN 'clinic'
 WHEN 4 THEN 'university' WHEN 5 THEN 'dentist' WHEN 6 THEN 'cafe' WHEN 7 THEN 'cinema' WHEN 8 THEN 'bank'
 WHEN 9 THEN 'post_office' END"""
SHOP = "CASE k % 9 WHEN 0 THEN 'supermarket' WHEN 1 THEN 'mall' END"
LEISURE = "CASE k % 11 WHEN 0 THEN 'park' WHEN 1 THEN 'sports_centre' END"


def elements(spark, sf):
    k = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey",
        lat_of(F.col("o_orderkey") * 3 + 1).alias("y"), lon_of(F.col("o_orderkey") * 3 + 1).alias("x"),
    )
    return k.selectExpr(
        "k as id",
        "case when k % 5 = 0 then 0.0D when k % 5 < 4 then y end as lat",
        "case when k % 5 = 0 then 0.0D when k % 5 < 4 then x end as lon",
        "case when k % 5 = 0 then named_struct('lat', y, 'lon', x) end as center",
        f"""map_filter(map('amenity', {AMENITY}, 'shop', {SHOP}, 'leisure', {LEISURE},
          'construction', case when k % 10 = 3 then 'yes' end,
          'landuse', case when k % 10 = 4 then 'construction' end,
          'planned:amenity', case when k % 20 = 5 then 'school' end,
          'name', case when k % 3 <> 0 then concat('n', o_custkey) end), (t, v) -> v is not null) as tags""",
    )


SQL_ELEMENTS = f"""raw AS (SELECT o_orderkey AS k, o_custkey, {sql_lat('(o_orderkey * 3 + 1)')} AS y, {sql_lon('(o_orderkey * 3 + 1)')} AS x FROM orders),
els AS (SELECT k AS id, CASE WHEN k % 5 < 4 THEN y END AS lat, CASE WHEN k % 5 < 4 THEN x END AS lon,
   {AMENITY} AS amenity, {SHOP} AS shop, {LEISURE} AS leisure, k % 20 = 5 AS planned,
   NOT (k % 10 IN (3, 4) OR k % 20 = 5) AS works, CASE WHEN k % 3 <> 0 THEN 'n' || o_custkey END AS name FROM raw),
cats AS (
  SELECT * FROM (SELECT *, unnest(['school', 'kindergarten', 'shop', 'parking', 'park_forest', 'medical', 'university',
     'dentist', 'sport', 'food', 'mall', 'cinema', 'bank', 'post']) AS category FROM els)
  WHERE CASE category WHEN 'school' THEN amenity = 'school' OR planned WHEN 'kindergarten' THEN amenity = 'kindergarten'
   WHEN 'shop' THEN shop = 'supermarket' WHEN 'parking' THEN amenity = 'parking' WHEN 'park_forest' THEN leisure = 'park'
   WHEN 'medical' THEN amenity = 'clinic' WHEN 'university' THEN amenity = 'university' WHEN 'dentist' THEN amenity = 'dentist'
   WHEN 'sport' THEN leisure = 'sports_centre' WHEN 'food' THEN amenity = 'cafe' WHEN 'mall' THEN shop = 'mall'
   WHEN 'cinema' THEN amenity = 'cinema' WHEN 'bank' THEN amenity = 'bank' WHEN 'post' THEN amenity = 'post_office' END)"""

_D = sql_hav("p.lat", "p.lon", "e.lat", "e.lon")
SQL_PROFILE = f"""hits AS (SELECT p.slug, e.category, e.id, e.name, e.works, {_D} AS d FROM places p JOIN cats e ON {_D} <= 2000),
all_cats AS (SELECT DISTINCT category FROM cats),
profile AS (
  SELECT p.slug, c.category, count(h.id) AS count, min(d) FILTER (works) AS closest_distance_m,
   arg_min({{'n': h.name}}, (d, id)) FILTER (works) AS closest, count_if(coalesce(works, false)) AS count_operational,
   count_if(NOT coalesce(works, true)) AS count_under_construction, min(d) FILTER (NOT works) AS closest_under_construction_m
  FROM places p CROSS JOIN all_cats c LEFT JOIN hits h ON h.slug = p.slug AND h.category = c.category
  WHERE p.lat IS NOT NULL GROUP BY p.slug, c.category)"""


@query("p2_is_operational", with_sql(SQL_ELEMENTS) + "SELECT id, works FROM els")
def p2_is_operational(spark, sf):
    return elements(spark, sf).select("id", ops.is_operational().alias("works"))


@query("p3_poi_category", with_sql(SQL_ELEMENTS) + "SELECT id, category FROM cats")
def p3_poi_category(spark, sf):
    return elements(spark, sf).select("id", F.explode(ops.poi_categories()).alias("category"))


@query(
    "j10_poi_place_join",
    with_sql(SQL_PLACES, SQL_ELEMENTS)
    + f"SELECT p.slug, e.id, round({_D}, 1) AS dist_m FROM places p JOIN els e ON {_D} <= 2000",
)
def j10_poi_place_join(spark, sf):
    from wishgrid.operators.spatial import radius_join

    spots = ops.element_points(elements(spark, sf)).selectExpr("id as place_id", "id as ord", "e_lat as lat", "e_lon as lon")
    near = radius_join(places(spark, sf).selectExpr("slug as point_id", "lat", "lon"), spots, 2000.0, digits=1)
    return near.selectExpr("point_id as slug", "place_id as id", "dist_m")


@query(
    "a1_poi_profile",
    with_sql(SQL_PLACES, SQL_ELEMENTS, SQL_PROFILE)
    + """SELECT slug, category, count, round(closest_distance_m, 1) AS closest_distance_m, closest.n AS closest_name,
 closest_distance_m IS NOT NULL AND closest.n IS NULL AS closest_unnamed, count_operational, count_under_construction,
 round(closest_under_construction_m, 1) AS closest_under_construction_m FROM profile""",
)
def a1_poi_profile(spark, sf):
    out = ops.poi_profile(places(spark, sf), elements(spark, sf))
    return out.selectExpr(
        "slug", "category", "count", "round(closest_distance_m, 1) as closest_distance_m", "closest_name",
        "closest_unnamed", "count_operational", "count_under_construction",
        "round(closest_under_construction_m, 1) as closest_under_construction_m",
    )


# --- measured records: one per (supplier, category), made from the lines of the supplier ----------

RECORD = """l_suppkey AS s, CASE l_linenumber % 7 WHEN 0 THEN 'school' WHEN 1 THEN 'shop' WHEN 2 THEN 'bank' WHEN 3 THEN 'food'
 WHEN 4 THEN 'sport' WHEN 5 THEN 'mall' ELSE 'post' END AS category"""
RECORD_FIELDS = {
    "count": "n % 5",
    "closest_distance_m": "CASE WHEN n % 4 <> 0 THEN CAST(top AS DOUBLE) * 40 END",
    "closest_name": "CASE WHEN n % 3 = 0 THEN CONCAT('o', top) END",
    "closest_unnamed": "n % 3 = 1",
    "count_operational": "n % 4",
    "count_under_construction": "n % 2",
    "closest_under_construction_m": "CASE WHEN n % 2 = 1 THEN CAST(low AS DOUBLE) * 400 END",
    "schema_version": "CASE WHEN n % 6 = 0 THEN 1 ELSE 2 END",
}


def poi_records(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(*[e.strip() for e in _split(RECORD)], "cast(l_quantity as int) as q")
    g = lines.where("s % 4 <> 1 or category <> 'shop'").groupBy("s", "category").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("q").alias("top"), F.min("q").alias("low")
    )
    return g.selectExpr("concat('c', s) as slug", "category", *[f"{e} as {n}" for n, e in RECORD_FIELDS.items()])


def _split(text: str) -> list[str]:
    head, tail = text.split(", ", 1)
    return [head, tail]


SQL_RECORDS = f"""poi AS (SELECT 'c' || s AS slug, category, {', '.join(f'{e} AS {n}' for n, e in RECORD_FIELDS.items())}
  FROM (SELECT s, category, count(*)::INT AS n, max(q) AS top, min(q) AS low
        FROM (SELECT {RECORD}, l_quantity::INT AS q FROM lineitem) WHERE s % 4 <> 1 OR category <> 'shop' GROUP BY ALL))"""


@query(
    "s6_read_poi_cache",
    with_sql(SQL_RECORDS)
    + "SELECT slug, category, count, closest_name, count_operational, schema_version FROM poi",
)
def s6_read_poi_cache(spark, sf):
    path = scratch_path(spark, "poi-cache")
    record = ", ".join(f"'{n}', {n}" for n in RECORD_FIELDS)
    docs = (
        poi_records(spark, sf)
        .selectExpr("slug", "category", f"named_struct({record}) as r")
        .groupBy("slug")
        .agg(F.expr("to_json(map_from_entries(collect_list(struct(category, r))))").alias("doc"))
    )
    docs.write.parquet(path)
    return poi_long(spark.read.parquet(path)).select(
        "slug", "category", "count", "closest_name", "count_operational", "schema_version"
    )


@query(
    "p14_stale_poi",
    with_sql(SQL_RECORDS) + "SELECT slug, category FROM poi WHERE schema_version < 2 AND closest_distance_m IS NOT NULL",
)
def p14_stale_poi(spark, sf):
    return ops.stale_poi(poi_records(spark, sf)).select("slug", "category")


@query(
    "p14_refresh_worklist",
    with_sql(SQL_PLACES, SQL_RECORDS)
    + f"""SELECT p.slug, c.category FROM places p, (SELECT unnest([{', '.join(repr(c) for c in CATEGORY_TAGS)}]) AS category) c
WHERE p.lat IS NOT NULL AND NOT EXISTS (SELECT 1 FROM poi WHERE poi.slug = p.slug AND poi.category = c.category AND schema_version >= 2)""",
)
def p14_refresh_worklist(spark, sf):
    return ops.refresh_worklist(places(spark, sf), poi_records(spark, sf)).select("slug", "category")


# Requirements: two categories per customer; matched complexes: the suppliers of its orders.
REQ1 = "CASE k % 8 WHEN 0 THEN 'school' WHEN 1 THEN 'shop' WHEN 2 THEN 'bank' WHEN 3 THEN 'cinema' ELSE 'food' END"
REQ_MAX = "CASE WHEN k % 3 = 0 THEN 1900 WHEN k % 3 = 1 THEN 600 END"


def requirements(spark, sf):
    k = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    first = k.selectExpr("k as query_id", f"{REQ1} as category", "k % 10 = 7 as only_new", f"{REQ_MAX} as max_distance_m")
    second = k.where("k % 2 = 0").selectExpr("k as query_id", "'post' as category", "false as only_new", "cast(null as int) as max_distance_m")
    return first.unionByName(second)


SQL_REQS = f"""reqs AS (SELECT k AS query_id, {REQ1} AS category, k % 10 = 7 AS only_new, {REQ_MAX} AS max_distance_m FROM (SELECT c_custkey AS k FROM customer)
  UNION ALL SELECT c_custkey, 'post', false, NULL FROM customer WHERE c_custkey % 2 = 0)"""


def matched(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    n = lines.count()
    pairs = (
        table(spark, sf, "orders")
        .join(dealt(lines, n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select(F.col("o_custkey").alias("query_id"), F.col("l_suppkey").alias("ord"))
    )
    return dealt(pairs, n, "query_id", "ord").distinct().withColumn("slug", F.expr("concat('c', ord)"))


SQL_MATCHED = """matched AS (SELECT DISTINCT o_custkey AS query_id, l_suppkey AS ord, 'c' || l_suppkey AS slug FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


@query(
    "a2_poi_evidence",
    with_sql(SQL_RECORDS, SQL_REQS, SQL_MATCHED)
    + """, rows AS (SELECT * FROM (SELECT DISTINCT query_id, category FROM reqs) JOIN matched USING (query_id) JOIN poi USING (slug, category)),
near AS (SELECT * FROM rows WHERE closest_distance_m IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY closest_distance_m, ord) = 1),
sums AS (SELECT query_id, category, sum(count_under_construction)::BIGINT AS under_construction FROM rows GROUP BY ALL)
SELECT query_id, category, slug, closest_distance_m AS distance_m, closest_name AS object_name,
 CASE WHEN closest_name <> '' THEN 'named' WHEN closest_unnamed THEN 'unnamed' ELSE 'not_recorded' END AS object_label,
 schema_version >= 2 AS current, under_construction,
 under_construction > 0 AND coalesce(closest_under_construction_m < closest_distance_m, false) AS site_is_closer
FROM near JOIN sums USING (query_id, category)""",
)
def a2_poi_evidence(spark, sf):
    return ops.poi_evidence(requirements(spark, sf).select("query_id", "category"), matched(spark, sf), poi_records(spark, sf))


@query(
    "w9_uncollected_categories",
    with_sql(SQL_RECORDS, SQL_REQS, SQL_MATCHED)
    + """SELECT DISTINCT query_id, category FROM reqs r WHERE query_id IN (SELECT query_id FROM matched)
AND NOT EXISTS (SELECT 1 FROM matched m JOIN poi p USING (slug) WHERE m.query_id = r.query_id AND p.category = r.category)""",
)
def w9_uncollected_categories(spark, sf):
    return ops.uncollected_categories(requirements(spark, sf), matched(spark, sf), poi_records(spark, sf))
