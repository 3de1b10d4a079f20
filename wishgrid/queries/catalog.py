"""Catalogue operators: parts are catalogue entries and map nodes, customers the provider feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishgrid.operators import catalog as ops
from wishgrid.packs.params import DISTRUSTED_METRO_IDS
from wishgrid.queries.base import SQL_PLACES, SQL_STATIONS, places, sql_key, stations, table, with_sql
from wishgrid.queries.registry import query
from wishgrid.session import scratch_path, through_table
from wishgrid.sources import catalog as sources
from wishgrid.sources.ring import edges_of_vertices

# --- catalogue entries: one per part, with repeated names, slugs and ids -----------------------


def entries(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "'complexes' as kind",
        "p_partkey as ord",
        "concat_ws(' ', initcap(p_name), p_size) as name",
        "case when p_partkey % 3 = 0 then concat('pt', p_partkey % 500) end as slug",
        "case when p_partkey % 4 = 0 then concat('i', p_partkey % 700) end as id",
        "array(concat_ws(' ', p_type, p_partkey % 50)) as aliases",
        "case when p_partkey % 5 = 0 then 55.0D + p_size / 100.0D end as lat",
        "case when p_partkey % 5 = 0 then 37.0D + p_size / 100.0D end as lon",
        "cast(null as boolean) as is_center",
        "cast(null as string) as category",
        "p_brand as district",
        "cast(null as string) as county",
        "cast(null as string) as metro",
        "case when p_partkey % 6 = 0 then concat(p_brand, ' / ', p_type) end as line",
    )


SQL_ENTRIES = """entries AS (
  SELECT p_partkey AS ord, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') || ' ' || p_size AS name,
    CASE WHEN p_partkey % 3 = 0 THEN 'pt' || (p_partkey % 500) END AS slug,
    CASE WHEN p_partkey % 4 = 0 THEN 'i' || (p_partkey % 700) END AS id,
    p_type || ' ' || (p_partkey % 50) AS alias,
    CASE WHEN p_partkey % 5 = 0 THEN 55.0 + p_size / 100.0 END::DOUBLE AS lat,
    CASE WHEN p_partkey % 5 = 0 THEN 37.0 + p_size / 100.0 END::DOUBLE AS lon, p_brand AS district,
    CASE WHEN p_partkey % 6 = 0 THEN p_brand || ' / ' || p_type END AS line FROM part)"""


@query(
    "s1_read_catalog",
    with_sql(SQL_ENTRIES) + "SELECT ord, name, slug, id, alias, round(lat, 4) AS lat, line FROM entries",
)
def s1_read_catalog(spark, sf):
    path = scratch_path(spark, "entries")
    entries(spark, sf).write.json(path)
    back = sources.read_entries(spark, path)
    return back.selectExpr("ord", "name", "slug", "id", "aliases[0] as alias", "round(lat, 4) as lat", "line")


@query("s1_unknown_fields", "SELECT 'p_size' AS field, count(*) AS n FROM part")
def s1_unknown_fields(spark, sf):
    path = scratch_path(spark, "entries")
    table(spark, sf, "part").selectExpr("p_partkey as ord", "p_name as name", "p_size").write.json(path)
    return sources.unknown_entry_fields(spark, path)


@query(
    "s7_write_catalog",
    with_sql(SQL_ENTRIES)
    + f"""SELECT name, slug, (1 + (slug IS NOT NULL)::INT + (id IS NOT NULL)::INT + 3
  + 2 * (lat IS NOT NULL)::INT + (line IS NOT NULL)::INT + 1)::BIGINT AS n_fields FROM entries""",
)
def s7_write_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    sources.write_catalog(entries(spark, sf), path)
    return spark.read.text(path).selectExpr(
        "get_json_object(value, '$.name') as name",
        "get_json_object(value, '$.slug') as slug",
        "cast(size(json_object_keys(value)) as bigint) as n_fields",
    )


@query(
    "s8_write_report",
    "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1",
)
def s8_write_report(spark, sf):
    path = scratch_path(spark, "report")
    report = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sources.write_report(report, path)
    return spark.read.schema("segment string, n bigint").json(path)


# --- feed: one block per customer -------------------------------------------------------------


def feed_rows(spark, sf):
    part = table(spark, sf, "part").selectExpr(
        "p_partkey as c_custkey", "concat_ws(' ', p_name, p_size) as p_label"
    )
    nation = table(spark, sf, "nation").selectExpr("n_nationkey as c_nationkey", "n_name", "n_regionkey")
    return (
        table(spark, sf, "customer")
        .join(part, "c_custkey", "left")
        .join(nation, "c_nationkey", "left")
        .selectExpr(
            "case when c_custkey % 13 <> 0 then c_custkey end as id",
            "case when c_custkey % 10 <> 0 then coalesce(p_label, c_name) end as name",
            "case when c_custkey % 3 = 0 then concat('/pt', c_custkey % 600, '/') else '' end as url",
            "case when c_custkey % 2 = 0 then c_mktsegment end as metro",
            "n_name as district",
            "case when c_custkey % 7 = 0 then 0.0D else 50 + c_custkey % 10 end as latitude",
            "case when c_custkey % 7 <> 0 then 30.0D + c_custkey % 10 end as longitude",
            "named_struct('parent', named_struct('name', case when c_custkey % 2 = 0 then 'Москва' else 'Other' end),"
            " 'child', named_struct('id', cast(n_regionkey as bigint), 'name', concat('R', n_regionkey),"
            " 'url', case when n_regionkey % 2 = 0 then concat('r', n_regionkey) else '' end)) as locations",
            "c_custkey as pos",
        )
    )


SQL_FEED = """feed AS (
  SELECT c_custkey AS pos, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey END AS id,
    CASE WHEN c_custkey % 10 <> 0 THEN coalesce(p_name || ' ' || p_size, c_name) END AS name,
    CASE WHEN c_custkey % 3 = 0 THEN 'pt' || (c_custkey % 600) END AS slug,
    CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS metro, n_name AS district,
    CASE WHEN c_custkey % 7 <> 0 THEN (50 + c_custkey % 10)::DOUBLE END AS lat,
    CASE WHEN c_custkey % 7 <> 0 THEN (30 + c_custkey % 10)::DOUBLE END AS lon,
    CASE WHEN c_custkey % 2 = 0 THEN 'R' || n_regionkey END AS county, n_regionkey,
    c_custkey % 7 = 0 AS zero_lat
  FROM customer LEFT JOIN part ON p_partkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""


@query("s2_read_feed", with_sql(SQL_FEED) + "SELECT id, name, slug, metro, county IS NOT NULL AS capital FROM feed")
def s2_read_feed(spark, sf):
    path = scratch_path(spark, "feed")
    feed_rows(spark, sf).drop("pos").write.json(path)
    feed = sources.read_feed(spark, path, lines=True)
    return feed.selectExpr(
        "id", "name", "nullif(trim(both '/' from url), '') as slug", "metro", "locations.parent.name = 'Москва' as capital"
    )


SQL_FETCHED = f"""fetched AS (
  SELECT * EXCLUDE (rn, id, lat), id::VARCHAR AS id, CASE WHEN zero_lat THEN 0.0 ELSE lat END AS lat FROM (
    SELECT *, row_number() OVER (PARTITION BY {sql_key('name')} ORDER BY pos) AS rn FROM feed WHERE name IS NOT NULL) WHERE rn = 1)"""


@query(
    "u5_complexes_from_feed",
    with_sql(SQL_FEED, SQL_FETCHED) + "SELECT name, slug, id, lat, lon, district, county, metro FROM fetched",
)
def u5_complexes_from_feed(spark, sf):
    return ops.complexes_from_feed(feed_rows(spark, sf)).drop("ord")


@query(
    "u5_counties_from_feed",
    with_sql(SQL_FEED)
    + """SELECT county AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey END AS slug, n_regionkey::VARCHAR AS id
FROM (SELECT DISTINCT county, n_regionkey FROM feed WHERE county IS NOT NULL)""",
)
def u5_counties_from_feed(spark, sf):
    return ops.counties_from_feed(feed_rows(spark, sf)).drop("ord")


@query(
    "u6_dedupe_first",
    with_sql(SQL_ENTRIES)
    + f"SELECT name, min(ord) AS ord FROM (SELECT *, {sql_key('name')} AS k FROM entries) GROUP BY k, name",
)
def u6_dedupe_first(spark, sf):
    return ops.dedupe_first(entries(spark, sf)).select("name", "ord")


SQL_LINKED = f"""keys AS (
  SELECT {sql_key('name')} AS key, ord FROM entries UNION ALL SELECT {sql_key('alias')}, ord FROM entries),
links AS (
  SELECT f.pos AS f_ord, coalesce(s.ord, n.ord) AS ord, s.ord IS NOT NULL AS by_slug
  FROM fetched f LEFT JOIN (SELECT slug, max(ord) AS ord FROM entries WHERE slug IS NOT NULL GROUP BY slug) s ON s.slug = f.slug
  LEFT JOIN (SELECT key, min(ord) AS ord FROM keys GROUP BY key) n ON n.key = {sql_key('f.name')}
  WHERE coalesce(s.ord, n.ord) IS NOT NULL)"""


@query(
    "j12_link_records",
    with_sql(SQL_FEED, SQL_FETCHED, SQL_ENTRIES, SQL_LINKED) + "SELECT f_ord, ord, by_slug FROM links",
)
def j12_link_records(spark, sf):
    return ops.link_records(entries(spark, sf), ops.complexes_from_feed(feed_rows(spark, sf)))


@query(
    "u7_merge_catalog",
    with_sql(SQL_FEED, SQL_FETCHED, SQL_ENTRIES, SQL_LINKED)
    + """, news AS (
  SELECT l.ord, arg_max(f.name, f_ord) FILTER (by_slug) AS name, arg_max(f.slug, f_ord) FILTER (f.slug IS NOT NULL) AS slug,
    arg_max(f.id, f_ord) FILTER (f.id IS NOT NULL) AS id, arg_max(f.lat, f_ord) FILTER (f.lat <> 0) AS lat,
    arg_max(f.district, f_ord) FILTER (f.district IS NOT NULL) AS district,
    arg_max(f.metro, f_ord) FILTER (f.metro IS NOT NULL) AS metro
  FROM links l JOIN fetched f ON f.pos = l.f_ord GROUP BY l.ord)
SELECT coalesce(n.name, e.name) AS name, coalesce(n.slug, e.slug) AS slug, coalesce(n.id, e.id) AS id,
  round(coalesce(n.lat, e.lat), 4) AS lat, coalesce(n.district, e.district) AS district, n.metro, e.alias
FROM entries e LEFT JOIN news n USING (ord)
UNION ALL SELECT name, slug, id, lat, district, metro, NULL FROM fetched WHERE pos NOT IN (SELECT f_ord FROM links)""",
)
def u7_merge_catalog(spark, sf):
    merged = ops.merge_catalog(entries(spark, sf), ops.complexes_from_feed(feed_rows(spark, sf)))
    return merged.selectExpr("name", "slug", "id", "round(lat, 4) as lat", "district", "metro", "get(aliases, 0) as alias")


@query(
    "u10_refresh_all",
    with_sql(SQL_FEED, SQL_FETCHED, SQL_ENTRIES, SQL_LINKED)
    + """SELECT 'complexes' AS kind, (SELECT count(*) FROM entries) + count(*) AS size FROM fetched WHERE pos NOT IN (SELECT f_ord FROM links)
UNION ALL SELECT 'counties', count(DISTINCT county) FROM feed
UNION ALL SELECT 'metro', (SELECT count(*) FROM entries)
UNION ALL SELECT 'districts', (SELECT count(*) FROM nation)""",
)
def u10_refresh_all(spark, sf):
    base = entries(spark, sf)
    nations = table(spark, sf, "nation").selectExpr(
        "'districts' as kind", "cast(n_nationkey as bigint) as ord", "n_name as name", "cast(null as string) as slug",
        "cast(null as string) as id", "cast(array() as array<string>) as aliases", "cast(null as double) as lat",
        "cast(null as double) as lon", "cast(null as string) as district", "cast(null as string) as county",
        "cast(null as string) as metro",
    )
    merged = ops.refresh_all(
        feed_rows(spark, sf),
        {"complexes": base, "counties": base.where("false"), "metro": base, "districts": nations},
    )
    sizes = [
        df.agg(F.count(F.lit(1)).alias("size")).select(F.lit(kind).alias("kind"), "size") for kind, df in merged.items()
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3])


# --- map elements: parts are nodes, customers route relations over their ordered parts ----------

NODE_TAGS = """map_filter(map('name', concat_ws(' ', p_name, p_size), 'railway', case p_partkey % 4 when 0 then 'station' when 1 then 'halt'
 when 2 then 'switch' end, 'public_transport', case when p_partkey % 8 = 2 then 'platform' end,
 'alt_name', case when p_partkey % 9 = 0 then concat(p_type, '; ', p_name, ' ', p_size) end,
 'short_name', case when p_partkey % 10 = 0 then p_brand end), (k, v) -> v is not null)"""


def elements(spark, sf):
    nodes = table(spark, sf, "part").selectExpr(
        "'node' as type", "p_partkey as id", "50.0D + p_partkey / 1000.0D as lat",
        "case when p_partkey % 31 <> 0 then 30.0D + p_partkey / 1000.0D end as lon",
        "cast(null as struct<lat: double, lon: double>) as center", f"{NODE_TAGS} as tags",
        "cast(null as array<struct<type: string, ref: bigint, role: string>>) as members",
    )
    members = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.expr(
            "transform(collect_set(l_partkey), p -> named_struct('type', case when p % 12 = 0 then 'way' else 'node' end, 'ref', p, 'role', 'stop'))"
        ).alias("members")
    )
    relations = table(spark, sf, "orders").join(members, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "'relation' as type", "o_orderkey as id", "cast(null as double) as lat", "cast(null as double) as lon",
        "cast(null as struct<lat: double, lon: double>) as center",
        """case o_orderkey % 5
          when 0 then map('network', 'МЦД', 'ref', concat('D', o_custkey % 4), 'route', 'train')
          when 1 then map('route', 'train', 'ref', '14')
          when 2 then map('route', 'subway', 'name', concat('Ring ', o_custkey % 3, ' Линия: A => B'))
          when 3 then map('route', 'subway', 'name', concat('Line ', o_custkey % 6, ' (east)'))
          else map('route', 'bus', 'name', 'x') end as tags""",
        "members",
    )
    return nodes.unionByName(relations)


SQL_ELEMENTS = f"""nodes AS (
  SELECT p_partkey AS node_id, p_name || ' ' || p_size AS name, 50.0 + p_partkey / 1000.0 AS lat,
    CASE p_partkey % 4 WHEN 0 THEN 'station' WHEN 1 THEN 'halt' WHEN 2 THEN 'switch' END AS railway,
    p_partkey % 8 = 2 AS platform, CASE WHEN p_partkey % 9 = 0 THEN p_type END AS a1,
    CASE WHEN p_partkey % 10 = 0 THEN p_brand END AS a2, p_partkey % 31 <> 0 AS located FROM part),
station_nodes AS (SELECT * FROM nodes WHERE located AND (railway IN ('station', 'halt') OR platform)),
relations AS (
  SELECT o_orderkey AS relation_id, CASE o_orderkey % 5 WHEN 0 THEN 'МЦД-' || (o_custkey % 4) WHEN 1 THEN 'МЦК'
    WHEN 2 THEN 'Ring ' || (o_custkey % 3) WHEN 3 THEN 'Line ' || (o_custkey % 6) END AS label FROM orders),
members AS (
  SELECT DISTINCT r.relation_id, r.label, n.* FROM relations r JOIN lineitem ON l_orderkey = relation_id AND l_partkey % 12 <> 0
  JOIN station_nodes n ON node_id = l_partkey WHERE label IS NOT NULL)"""


@query(
    "s3_read_osm",
    "SELECT 'node' AS type, count(*) AS n, 0::BIGINT AS members FROM part UNION ALL "
    "SELECT 'relation', count(DISTINCT l_orderkey), count(DISTINCT (l_orderkey, l_partkey)) FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
)
def s3_read_osm(spark, sf):
    path = scratch_path(spark, "elements")
    elements(spark, sf).write.json(path)
    back = sources.read_osm(spark, path, lines=True)
    return back.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.expr("coalesce(sum(greatest(size(members), 0)), 0)").alias("members")
    )


@query(
    "p4_is_station_node",
    with_sql(SQL_ELEMENTS)
    + "SELECT node_id AS id, coalesce(railway IN ('station', 'halt'), false) OR platform AS is_station FROM nodes",
)
def p4_is_station_node(spark, sf):
    nodes = elements(spark, sf).where("type = 'node'")
    return nodes.select("id", ops.is_station_node().alias("is_station"))


@query(
    "p5_line_label",
    with_sql(SQL_ELEMENTS) + "SELECT label, count(*) AS n FROM relations WHERE relation_id IN (SELECT l_orderkey FROM lineitem) GROUP BY label",
)
def p5_line_label(spark, sf):
    rel = elements(spark, sf).where("type = 'relation'")
    return rel.groupBy(ops.line_label().alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("j11_relation_members", with_sql(SQL_ELEMENTS) + "SELECT relation_id, node_id, label, name FROM members")
def j11_relation_members(spark, sf):
    return ops.relation_members(elements(spark, sf)).select("relation_id", "node_id", "label", "name")


SQL_OSM_STATIONS = f"""osm_stations AS (
  SELECT k AS key, arg_min(name, node_id) AS name, arg_min(lat, node_id) AS lat,
   array_to_string(list_sort(list(DISTINCT label)), ' / ') AS line, list(DISTINCT label) AS labels FROM (SELECT *, {sql_key('name')} AS k FROM members) GROUP BY k)"""


@query(
    "a3_stations_from_osm",
    with_sql(SQL_ELEMENTS, SQL_OSM_STATIONS)
    + f""", al AS (SELECT k, a, {sql_key('a')} AS ak FROM (SELECT {sql_key('name')} AS k, unnest([a1, a2]) AS a FROM members) WHERE a IS NOT NULL)
SELECT key, name, round(lat, 4) AS lat, line, coalesce(n, 0) AS n_aliases
FROM osm_stations LEFT JOIN (SELECT k, count(DISTINCT ak) AS n FROM al WHERE ak <> k GROUP BY k) ON k = key""",
)
def a3_stations_from_osm(spark, sf):
    out = ops.stations_from_osm(elements(spark, sf))
    return out.selectExpr("key", "name", "round(lat, 4) as lat", "line", "cast(size(aliases) as bigint) as n_aliases")


# Existing stations of J13/U8: names equal to, or one letter away from, the nodes' names.
def station_entries(spark, sf):
    return table(spark, sf, "part").where("p_size % 3 <> 0").selectExpr(
        "p_partkey as ord",
        "case when p_size % 5 = 0 then concat_ws(' ', p_name, p_size, '') else concat_ws(' ', 'z', p_name, p_type, p_size) end as name",
        "cast(null as string) as slug",
        "array(concat_ws(' ', p_name, p_size + 1), concat_ws(' ', concat(p_name, 's'), p_size)) as aliases",
        "cast(null as double) as lat", "cast(null as double) as lon",
        "case when p_partkey % 2 = 0 then 'Old / Line 1' end as line",
    )


SQL_STATION_ENTRIES = f"""st AS (
  SELECT p_partkey AS ord, CASE WHEN p_size % 5 = 0 THEN p_name || ' ' || p_size ELSE 'z ' || p_name || ' ' || p_type || ' ' || p_size END AS name,
   p_name || ' ' || (p_size + 1) AS al1, p_name || 's ' || p_size AS al2,
   CASE WHEN p_partkey % 2 = 0 THEN 'Old / Line 1' END AS line FROM part WHERE p_size % 3 <> 0),
st_keys AS (SELECT ord, 0 AS seq, {sql_key('name')} AS key FROM st UNION ALL SELECT ord, 1, {sql_key('al1')} FROM st UNION ALL SELECT ord, 2, {sql_key('al2')} FROM st),
st_exact AS (
  SELECT key, min(ord) AS ord, 0 AS priority FROM st_keys WHERE seq = 0 GROUP BY key
  UNION ALL SELECT key, min(ord), 1 FROM st_keys WHERE seq > 0 AND key NOT IN (SELECT key FROM st_keys WHERE seq = 0) GROUP BY key)"""


def sql_similarity(a: str, b: str) -> str:
    """F2 in SQL: bit-parallel longest common subsequence over BIGINT masks."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = (
        f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(length({a})),"
        f" lambda i: CASE WHEN substring({a}, (i + 1)::INT, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)"
    )
    step = f"lambda v, m: (((v + (v & m)) | (v - (v & m))) & {full})::HUGEINT"
    left = f"list_reduce({mask}, {step}, {full}::HUGEINT)"
    return f"(200.0 * (length({a}) - bit_count({left})) / (length({a}) + length({b})))"


SQL_STATION_LINKS = f"""st_rest AS (SELECT key FROM osm_stations WHERE key NOT IN (SELECT key FROM st_exact) AND length(key) >= 6),
st_pairs AS (SELECT a.key AS a, b.key AS b, {sql_similarity('a.key', 'b.key')} AS score
  FROM st_rest a JOIN (SELECT DISTINCT key FROM st_keys WHERE length(key) >= 6) b ON abs(length(a.key) - length(b.key)) <= 4),
st_links AS (
  SELECT o.key, e.ord, e.priority FROM osm_stations o JOIN st_exact e USING (key)
  UNION ALL SELECT a AS key, arg_max(k.ord, (score, k.ord, k.seq)), 2 FROM st_pairs JOIN st_keys k ON k.key = b WHERE score >= 93 - 1e-9 GROUP BY a)"""


@query(
    "j13_link_stations",
    with_sql(SQL_ELEMENTS, SQL_OSM_STATIONS, SQL_STATION_ENTRIES, SQL_STATION_LINKS)
    + "SELECT key, ord, priority FROM st_links",
)
def j13_link_stations(spark, sf):
    fetched = through_table(ops.stations_from_osm(elements(spark, sf)), "stations")
    return ops.link_stations(station_entries(spark, sf), fetched)


SQL_STATION_MERGE = """news AS (
  SELECT ord, list_distinct(flatten(list(labels))) AS labels, arg_min(lat, (priority, key)) AS lat
  FROM st_links JOIN osm_stations USING (key) GROUP BY ord),
merged AS (
  SELECT st.name, round(n.lat, 4) AS lat, CASE WHEN n.ord IS NULL THEN st.line ELSE
    array_to_string(list_sort(list_distinct(list_concat(n.labels, CASE WHEN st.line IS NULL THEN []::VARCHAR[] ELSE ['Old', 'Line 1'] END))), ' / ') END AS line, false AS added
  FROM st LEFT JOIN news n USING (ord)
  UNION ALL SELECT name, round(lat, 4), line, true FROM osm_stations WHERE key NOT IN (SELECT key FROM st_links))"""


@query(
    "u8_merge_stations",
    with_sql(SQL_ELEMENTS, SQL_OSM_STATIONS, SQL_STATION_ENTRIES, SQL_STATION_LINKS, SQL_STATION_MERGE)
    + "SELECT name, lat, line, added FROM merged",
)
def u8_merge_stations(spark, sf):
    fetched = through_table(ops.stations_from_osm(elements(spark, sf)), "stations")
    merged = ops.merge_stations(station_entries(spark, sf), fetched)
    return merged.selectExpr("trim(name) as name", "round(lat, 4) as lat", "line", "added")


@query(
    "u11_refresh_stations",
    with_sql(SQL_ELEMENTS, SQL_OSM_STATIONS, SQL_STATION_ENTRIES, SQL_STATION_LINKS, SQL_STATION_MERGE)
    + """SELECT count(*) AS total, count_if(added) AS added, count_if(lat IS NOT NULL) AS with_coords,
 count_if(coalesce(line, '') <> '') AS with_line, count_if(contains(line, 'МЦД')) AS diameter,
 (SELECT count(*) FROM osm_stations) AS fetched FROM merged""",
)
def u11_refresh_stations(spark, sf):
    return ops.refresh_stations(elements(spark, sf), station_entries(spark, sf))[1]


# --- look-ups ---------------------------------------------------------------------------------


@query(
    "j1_find_by_name",
    with_sql(SQL_STATIONS)
    + f"""SELECT a.p_partkey AS asked, min(s.ord) AS ord FROM part a JOIN stations s
ON {sql_key("upper(a.p_name) || '  ' || a.p_size")} = {sql_key('s.name')} GROUP BY a.p_partkey""",
)
def j1_find_by_name(spark, sf):
    cat = stations(spark, sf).withColumn("aliases", F.array().cast("array<string>")).drop("name").join(
        stations(spark, sf).select("ord", "name"), "ord"
    )
    names = table(spark, sf, "part").selectExpr("concat(upper(p_name), '  ', p_size) as name", "p_partkey")
    found = ops.find_by_name(cat, names.select("name").distinct()).select("asked", "ord")
    return names.join(found, names["name"] == found["asked"]).select(F.col("p_partkey").alias("asked"), "ord")


@query(
    "j2_by_tag",
    with_sql(SQL_PLACES)
    + f"""SELECT field, w.name, place_id FROM (SELECT 'district' AS field, upper(n_name) AS name FROM nation
  UNION ALL SELECT 'county', r_name FROM region) w
JOIN places p ON {sql_key('w.name')} = {sql_key("CASE w.field WHEN 'district' THEN p.district ELSE p.county END")}""",
)
def j2_by_tag(spark, sf):
    wanted = table(spark, sf, "nation").selectExpr("'district' as field", "upper(n_name) as name").union(
        table(spark, sf, "region").selectExpr("'county' as field", "r_name as name")
    )
    return ops.by_tag(places(spark, sf), wanted).select("field", "name", "place_id")


SQL_WANTED = """wanted AS (
  SELECT c_custkey AS query_id, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT c_custkey, p_name || ' ' || p_size FROM customer JOIN part ON p_partkey = c_custkey)"""


def wanted_names(spark, sf):
    customer = table(spark, sf, "customer")
    by_nation = customer.join(
        table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    ).selectExpr("c_custkey as query_id", "n_name as name")
    by_station = customer.join(
        table(spark, sf, "part"), F.col("p_partkey") == F.col("c_custkey")
    ).selectExpr("c_custkey as query_id", "concat_ws(' ', p_name, p_size) as name")
    return by_nation.union(by_station)


@query(
    "j3_location_filter",
    with_sql(SQL_PLACES, SQL_WANTED)
    + """SELECT DISTINCT query_id, ord FROM wanted w JOIN places p
ON lower(w.name) IN (lower(p.district), lower(p.county), lower(p.metro))""",
)
def j3_location_filter(spark, sf):
    return ops.location_filter(places(spark, sf), wanted_names(spark, sf))


@query(
    "j22_anchors",
    with_sql(SQL_STATIONS)
    + f"""SELECT query_id, round(s.lat, 4) AS lat, round(s.lon, 4) AS lon FROM
 (SELECT c_custkey AS query_id, p_name || ' ' || p_size AS name FROM customer JOIN part ON p_partkey = c_custkey) r
 JOIN (SELECT {sql_key('name')} AS k, min(ord) AS ord FROM stations GROUP BY 1) f ON f.k = {sql_key('r.name')}
 JOIN stations s ON s.ord = f.ord WHERE s.lat IS NOT NULL""",
)
def j22_anchors(spark, sf):
    requested = table(spark, sf, "customer").join(
        table(spark, sf, "part"), F.col("p_partkey") == F.col("c_custkey")
    ).selectExpr("c_custkey as query_id", "concat_ws(' ', p_name, p_size) as name")
    cat = stations(spark, sf).withColumn("aliases", F.expr("cast(array() as array<string>)"))
    out = ops.located_anchors(requested, cat)
    return out.selectExpr("query_id", "round(lat, 4) as lat", "round(lon, 4) as lon")


# --- rings --------------------------------------------------------------------------------------


@query(
    "s4_ring_edges",
    """SELECT c_nationkey::VARCHAR AS ring_id, round(a, 4) AS lat1, round(coalesce(lead(a) OVER w, first_value(a) OVER w), 4) AS lat2
FROM (SELECT c_nationkey, c_custkey, c_acctbal AS a FROM customer) WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def s4_ring_edges(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    vertices = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("ring_id"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.col("c_acctbal").alias("lat"),
        F.col("c_acctbal").alias("lon"),
    )
    return edges_of_vertices(vertices).selectExpr("ring_id", "round(lat1, 4) as lat1", "round(lat2, 4) as lat2")


# --- curation and quality -------------------------------------------------------------------------


def _curation(spark, sf):
    base = ops.dedupe_first(entries(spark, sf))
    # Curation lists derived from the names themselves; disjoint by the last digit of the key.
    slim = base.select("name", "ord", "slug", "id")
    delete = slim.where("ord % 10 = 1")
    duplicates = slim.where("ord % 10 = 2 and id is null and slug is null")
    target = slim.where("ord % 10 = 3").agg(F.min("name").alias("target")).withColumn("one", F.lit(1))
    merge = duplicates.withColumn("one", F.lit(1)).join(target, "one").selectExpr(
        "name as duplicate", "target", "cast(null as string) as extra_alias"
    )
    rename = slim.where("ord % 10 = 5").selectExpr("name as old", "concat(name, ' X') as new")
    return base, delete, merge, rename


SQL_CURATION = f"""base AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY {sql_key('name')} ORDER BY ord) = 1),
dups AS (SELECT * FROM base WHERE ord % 10 = 2 AND id IS NULL AND slug IS NULL),
target AS (SELECT min(name) AS name FROM base WHERE ord % 10 = 3)"""


@query(
    "u9_apply_curation",
    with_sql(SQL_ENTRIES, SQL_CURATION)
    + f"""SELECT CASE WHEN ord % 10 = 5 THEN name || ' X' ELSE name END AS name,
 1 + CASE WHEN ord % 10 = 5 THEN 1 WHEN name = (SELECT name FROM target) THEN
   (SELECT count(DISTINCT k) FROM (SELECT {sql_key('name')} AS k FROM dups UNION ALL SELECT {sql_key('alias')} FROM dups) WHERE k <> {sql_key('base.name')} AND k <> {sql_key('base.alias')}) ELSE 0 END AS n_aliases
FROM base WHERE ord % 10 <> 1 AND ord NOT IN (SELECT ord FROM dups)""",
)
def u9_apply_curation(spark, sf):
    out = ops.apply_curation(*_curation(spark, sf))
    return out.selectExpr("name", "cast(size(aliases) as bigint) as n_aliases")


@query(
    "u9_curation_errors",
    with_sql(SQL_ENTRIES, SQL_CURATION)
    + """SELECT DISTINCT name, 'has_id' AS problem FROM base WHERE ord % 10 = 4 AND (id IS NOT NULL OR slug IS NOT NULL)
UNION ALL SELECT c_name, 'unknown' FROM customer""",
)
def u9_curation_errors(spark, sf):
    base = ops.dedupe_first(entries(spark, sf))
    target = base.agg(F.min("name").alias("target")).withColumn("one", F.lit(1))
    merge = base.where("ord % 10 = 4").withColumn("one", F.lit(1)).join(target, "one").selectExpr(
        "name as duplicate", "target", "cast(null as string) as extra_alias"
    )
    delete = table(spark, sf, "customer").selectExpr("c_name as name")
    rename = base.where("ord % 10 = 5").selectExpr("name as old", "name as new")
    return ops.curation_errors(base, delete, merge, rename)


@query(
    "a24_catalog_quality",
    with_sql(SQL_ENTRIES)
    + f""", ids AS (SELECT DISTINCT 'i' || (l_suppkey * 3) AS id FROM lineitem),
gone AS (SELECT DISTINCT 'i' || (s_suppkey * 6) AS id FROM supplier)
SELECT 'duplicate_name' AS problem, {sql_key('name')} AS subject, count(*) AS n FROM entries GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'duplicate_id', id, count(*) FROM entries WHERE id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'orphan', name, count(*) FROM entries WHERE lat IS NULL AND slug IS NULL AND id IS NULL
  AND name NOT IN (SELECT name FROM entries WHERE ord % 7 = 0) GROUP BY 2
UNION ALL SELECT 'lost_id', id, 1 FROM ids WHERE id NOT IN (SELECT id FROM entries WHERE id IS NOT NULL) AND id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'returned_id', id, 1 FROM gone WHERE id IN (SELECT id FROM entries WHERE id IS NOT NULL)
UNION ALL SELECT 'fewer_ids', was::VARCHAR, n FROM (SELECT count(*) AS n FROM entries WHERE id IS NOT NULL),
  (SELECT count(*) AS was FROM ids WHERE id NOT IN (SELECT id FROM gone)) WHERE n < was""",
)
def a24_catalog_quality(spark, sf):
    base = entries(spark, sf)
    baseline = table(spark, sf, "lineitem").selectExpr("concat('i', l_suppkey * 3) as id").distinct()
    removed = table(spark, sf, "supplier").selectExpr("concat('i', s_suppkey * 6) as id").distinct()
    allowed = base.where("ord % 7 = 0").select("name").distinct()
    return ops.catalog_quality(base, baseline, allowed, removed)


# --- trust ------------------------------------------------------------------------------------

KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'metro' WHEN 1 THEN 'counties' WHEN 2 THEN 'districts' ELSE 'complexes' END"
SLUG = "CASE WHEN o_orderkey % 3 = 0 THEN 's' END"
ID = "CASE WHEN o_orderkey % 5 = 0 THEN 'guid-sokol' WHEN o_orderkey % 5 < 3 THEN CONCAT('i', o_custkey) END"
SQL_ENTITIES = f"""entities AS (SELECT o_custkey AS query_id, o_orderkey AS name, {KIND} AS kind, {SLUG} AS slug, {ID} AS id FROM orders),
trusted AS (SELECT *, id IS NOT NULL AND id NOT IN ({', '.join(repr(i) for i in DISTRUSTED_METRO_IDS)}) AS trusted FROM entities),
judged AS (SELECT *, CASE kind WHEN 'metro' THEN slug IS NULL AND NOT trusted WHEN 'counties' THEN slug IS NULL AND id IS NULL
  WHEN 'districts' THEN id IS NULL ELSE false END AS fallback, count(*) OVER (PARTITION BY query_id) AS total FROM trusted)"""


def entities(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_custkey as query_id", "o_orderkey as name", f"{KIND} as kind", f"{SLUG} as slug", f"{ID} as id"
    )
    distrusted = spark.createDataFrame([(i,) for i in DISTRUSTED_METRO_IDS], "id string")
    return ops.is_trusted_id(rows, distrusted)


@query("p6_is_trusted_id", with_sql(SQL_ENTITIES) + "SELECT name, trusted FROM judged")
def p6_is_trusted_id(spark, sf):
    return entities(spark, sf).select("name", "trusted")


@query("p7_needs_geo_fallback", with_sql(SQL_ENTITIES) + "SELECT name, fallback FROM judged")
def p7_needs_geo_fallback(spark, sf):
    return entities(spark, sf).select("name", ops.needs_geo_fallback().alias("fallback"))


@query(
    "p8_missing_id_warning",
    with_sql(SQL_ENTITIES)
    + """SELECT query_id, kind, name, code FROM (SELECT *, CASE WHEN total > 1 OR kind IN ('districts', 'complexes')
  THEN CASE WHEN id IS NULL THEN 'no_id' END WHEN slug IS NULL AND id IS NULL THEN 'no_slug_or_id' END AS code FROM judged)
WHERE code IS NOT NULL AND NOT fallback""",
)
def p8_missing_id_warning(spark, sf):
    return ops.missing_id_warning(entities(spark, sf))
