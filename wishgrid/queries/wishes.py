"""Extraction over wishes composed from orders; the SQL derives the expected fields from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishgrid.functions.text import normalize_chars
from wishgrid.operators import extract as e
from wishgrid.plans.parse import parse, parse_wishes
from wishgrid.queries.base import spread, table
from wishgrid.queries.registry import query

YEAR = 2026

# The same text in both engines; k is the order key, c the customer key.
PIECES = [
    "CASE k % 5 WHEN 0 THEN 'однушка' WHEN 1 THEN '2-комнатная квартира' WHEN 2 THEN 'студия или двушка' WHEN 3 THEN 'не студия' END",
    "CASE k % 4 WHEN 0 THEN CONCAT('до ', 5 + c % 40, ' млн') WHEN 1 THEN CONCAT('от ', 5 + c % 40, ' до ', 8 + c % 40, ' млн руб') WHEN 2 THEN CONCAT('бюджет ', 5 + c % 40) END",
    "CASE k % 3 WHEN 0 THEN CONCAT('площадь от ', 30 + c % 50) WHEN 1 THEN CONCAT('Кухня от ', 8 + c % 5, ' м2') END",
    "CASE k % 7 WHEN 0 THEN CONCAT('с ', 2 + c % 9, ' по ', 12 + c % 9, ' этаж') WHEN 1 THEN 'не первый этаж' WHEN 2 THEN CONCAT('не выше ', 2 + c % 9, ' этажа') WHEN 3 THEN 'первый этаж' WHEN 4 THEN 'последний этаж' END",
    "CASE k % 6 WHEN 0 THEN 'с отделкой' WHEN 1 THEN 'БЕЗ отделки' WHEN 2 THEN 'с мебелью' WHEN 3 THEN 'с ремонтом' END",
    "CASE k % 11 WHEN 0 THEN CONCAT('до метро ', 3 + c % 20, ' минут пешком') WHEN 1 THEN CONCAT('метро на машине ', 3 + c % 20, ' минут') END",
    "CASE k % 8 WHEN 0 THEN CONCAT('школа не дальше ', 100 * (1 + c % 9), ' м') WHEN 1 THEN 'парк поблизости' WHEN 2 THEN 'новый детский сад' WHEN 3 THEN 'школа и аптека в пределах 1 км' END",
    "CASE k % 9 WHEN 0 THEN 'подешевле' WHEN 1 THEN 'сначала дорогие' END",
    "CASE k % 10 WHEN 0 THEN 'внутри мкад' WHEN 1 THEN 'за мкад' END",
    "CASE k % 12 WHEN 0 THEN 'заселение с 2026 по 2028' WHEN 1 THEN 'сдача до 2027 года' WHEN 2 THEN 'въезд в этом году' WHEN 3 THEN 'сдан' END",
    "CASE k % 14 WHEN 0 THEN 'готовая квартира' WHEN 1 THEN 'только квартиры' WHEN 2 THEN 'без брони' WHEN 3 THEN 'кирпичный дом' WHEN 4 THEN 'вторичка' END",
    "CASE k % 15 WHEN 0 THEN CONCAT('рядом с мцд-', 1 + c % 4) WHEN 1 THEN 'у любого метро' WHEN 2 THEN 'фиолетовая ветка' WHEN 3 THEN 'у метро Зюзино' WHEN 4 THEN 'в центре' END",
    "CASE k % 13 WHEN 0 THEN 'широкий балкон' WHEN 1 THEN 'привет' WHEN 2 THEN 'абракадабра' WHEN 3 THEN 'ближайшая сауна' END",
]
TEXT = f"CONCAT_WS(', ', {', '.join(PIECES)})"
SQL_BASE = "(SELECT o_orderkey AS k, o_custkey AS c FROM orders)"


def wishes(spark, sf):
    rows = spread(table(spark, sf, "orders").selectExpr("o_orderkey as k", "o_custkey as c"), "k")
    return rows.selectExpr("k as query_id", f"{TEXT} as text")


def normed(spark, sf):
    return wishes(spark, sf).withColumn("norm", normalize_chars("text"))


SQL_ROOMS = "CASE k % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'studio,two' ELSE '' END"
SQL_PRICE_MIN = "CASE WHEN k % 4 = 1 THEN (5 + c % 40) * 1000000 END::BIGINT"
SQL_PRICE_MAX = "CASE k % 4 WHEN 0 THEN (5 + c % 40) * 1000000 WHEN 1 THEN (8 + c % 40) * 1000000 WHEN 2 THEN (5 + c % 40) * 1000000 END::BIGINT"
SQL_AREA_MIN = "CASE WHEN k % 3 = 0 THEN 30 + c % 50 END::DOUBLE"
SQL_KITCHEN = "CASE WHEN k % 3 = 1 THEN 8 + c % 5 END::DOUBLE"
SQL_FLOOR_MIN = "CASE k % 7 WHEN 0 THEN 2 + c % 9 WHEN 3 THEN 1 END::INT"
SQL_FLOOR_MAX = "CASE k % 7 WHEN 0 THEN 12 + c % 9 WHEN 2 THEN 2 + c % 9 WHEN 3 THEN 1 END::INT"
SQL_FINISH = "CASE k % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '3' WHEN 3 THEN '1' ELSE '' END"


def _q(fields: str) -> str:
    return f"SELECT k AS query_id, {fields} FROM {SQL_BASE}"


@query("e3_rooms", _q(f"{SQL_ROOMS} AS rooms"))
def e3_rooms(spark, sf):
    return e.rooms(normed(spark, sf)).selectExpr("query_id", "array_join(rooms, ',') as rooms")


@query("e4_price", _q(f"{SQL_PRICE_MIN} AS price_min, {SQL_PRICE_MAX} AS price_max"))
def e4_price(spark, sf):
    return e.price(normed(spark, sf)).select("query_id", "price_min", "price_max")


@query(
    "e5_area",
    _q(f"{SQL_AREA_MIN} AS area_min, {SQL_KITCHEN} AS area_kitchen_min, NULL::DOUBLE AS area_max, 0::BIGINT AS dropped"),
)
def e5_area(spark, sf):
    out = e.area(normed(spark, sf))
    return out.selectExpr("query_id", "area_min", "area_kitchen_min", "area_max", "cast(size(area_dropped) as bigint) as dropped")


@query(
    "e6_floor",
    _q(
        f"{SQL_FLOOR_MIN} AS floor_min, {SQL_FLOOR_MAX} AS floor_max, k % 7 = 1 AS not_first_floor, k % 7 = 4 AS last_floor, false AS not_last_floor"
    ),
)
def e6_floor(spark, sf):
    before = e.transit_time(e.area(e.price(e.rooms(normed(spark, sf)))))
    before = e.add(before, taken="concat(rooms_spans, price_spans, area_spans, time_spans)")
    return e.floor(before, "taken").select(
        "query_id", "floor_min", "floor_max", "not_first_floor", "last_floor", "not_last_floor"
    )


@query("e7_finish", _q(f"{SQL_FINISH} AS finish"))
def e7_finish(spark, sf):
    out = e.finish(normed(spark, sf))
    return out.selectExpr("query_id", "array_join(transform(finish, f -> cast(f as string)), ',') as finish")


@query("e8_ready", _q("CASE WHEN k % 12 = 3 THEN true END AS ready"))
def e8_ready(spark, sf):
    return e.finish(normed(spark, sf)).select("query_id", "ready")


@query(
    "e9_settlement_years",
    _q(
        "CASE k % 12 WHEN 0 THEN 2026 WHEN 2 THEN 2026 END::INT AS settlement_year_from,"
        " CASE k % 12 WHEN 0 THEN 2028 WHEN 1 THEN 2027 WHEN 2 THEN 2026 END::INT AS settlement_year_to"
    ),
)
def e9_settlement_years(spark, sf):
    return e.settlement(normed(spark, sf), YEAR).select("query_id", "settlement_year_from", "settlement_year_to")


@query("e10_sort_order", _q("CASE k % 9 WHEN 0 THEN 'price_asc' WHEN 1 THEN 'price_desc' END AS sort"))
def e10_sort_order(spark, sf):
    return e.sort_order(normed(spark, sf)).select("query_id", "sort")


@query("e11_required_tags", _q("CASE WHEN k % 14 = 0 THEN 'zos' ELSE '' END AS tags"))
def e11_required_tags(spark, sf):
    return e.required_tags(normed(spark, sf)).selectExpr("query_id", "array_join(required_tags, ',') as tags")


@query(
    "e12_housing_type",
    _q("CASE WHEN k % 14 = 1 THEN 'flats_only' END AS housing_type, k % 14 = 2 AS only_available"),
)
def e12_housing_type(spark, sf):
    return e.flags(normed(spark, sf)).select("query_id", "housing_type", "only_available")


@query(
    "e13_unsupported",
    f"""SELECT k AS query_id, CASE k % 14 WHEN 3 THEN 'кирпичный дом' ELSE 'вторичка' END AS fragment,
 CASE k % 14 WHEN 3 THEN 'house_material' ELSE 'resale' END AS reason FROM {SQL_BASE} WHERE k % 14 IN (3, 4)""",
)
def e13_unsupported(spark, sf):
    return e.unsupported(normed(spark, sf)).selectExpr("query_id", "inline_outer(unsupported)").where("fragment is not null")


@query("e14_within_ring", _q("CASE k % 10 WHEN 0 THEN true WHEN 1 THEN false END AS within_ring"))
def e14_within_ring(spark, sf):
    return e.flags(normed(spark, sf)).select("query_id", "within_ring")


@query(
    "e15_unmatched_station",
    f"SELECT k AS query_id, 'зюзино' AS station FROM {SQL_BASE} WHERE k % 15 = 3",
)
def e15_unmatched_station(spark, sf):
    out = parse(wishes(spark, sf), YEAR)
    return out.selectExpr("query_id", "explode_outer(unknown_stations) as station").where("station is not null")


@query(
    "e16_time_to_transit",
    _q(
        "CASE WHEN k % 11 = 0 THEN 3 + c % 20 END::INT AS time_on_foot,"
        " CASE WHEN k % 11 = 1 THEN 3 + c % 20 END::INT AS time_on_transport"
    ),
)
def e16_time_to_transit(spark, sf):
    return e.transit_time(normed(spark, sf)).select("query_id", "time_on_foot", "time_on_transport")


SQL_POI = """SELECT k AS query_id, CASE WHEN k % 8 = 1 THEN 'park_forest' WHEN k % 8 = 2 THEN 'kindergarten' ELSE 'school' END AS category,
   k % 8 = 2 AS only_new, CASE k % 8 WHEN 0 THEN 100 * (1 + c % 9) WHEN 3 THEN 1000 END::INT AS max_distance_m
 FROM base WHERE k % 8 <= 3 UNION ALL SELECT k, 'medical', false, 1000 FROM base WHERE k % 8 = 3"""


@query("e17_poi_requirements", f"WITH base AS {SQL_BASE} {SQL_POI}")
def e17_poi_requirements(spark, sf):
    out = e.poi_requirements(normed(spark, sf))
    return out.selectExpr("query_id", "inline_outer(poi_requirements)").where("category is not null").drop("raw_phrase")


@query("e17_center_requested", _q("k % 15 = 4 AS center_requested"))
def e17_center_requested(spark, sf):
    return e.poi_requirements(normed(spark, sf)).select("query_id", "center_requested")


@query(
    "a25_dedupe_poi_requirements",
    f"""WITH base AS {SQL_BASE}, p AS ({SQL_POI}), t AS (SELECT (query_id % 100) AS group_id, * FROM p)
SELECT group_id, category, only_new, min(max_distance_m)::INT AS max_distance_m, min(query_id) AS first_query FROM t GROUP BY ALL""",
)
def a25_dedupe_poi_requirements(spark, sf):
    from wishgrid.operators.audit import dedupe_requirements

    # the phrase tells which wish it came from
    rows = e.poi_requirements(normed(spark, sf)).selectExpr("query_id", "query_id % 100 as group_id", "inline_outer(poi_requirements)")
    rows = rows.where("category is not null").withColumn("raw_phrase", F.concat_ws(" ", F.md5(F.col("query_id").cast("string")), "query_id"))
    out = dedupe_requirements(rows, ["group_id"], "query_id")
    return out.selectExpr("group_id", "category", "only_new", "max_distance_m", "cast(split(raw_phrase, ' ')[1] as bigint) as first_query")


@query("e19_superlative_cue", _q("k % 13 = 3 AS cue"))
def e19_superlative_cue(spark, sf):
    return normed(spark, sf).selectExpr("query_id", f"{e.superlative_cue()} as cue")


# A coloured line right behind the ring road (within 22 characters) is a road.
_COLOURED = "left(t, instr(t, 'фиолетовая ветка') - 1)"


@query(
    "e20_station_class_requirements",
    f"""SELECT k AS query_id, CASE k % 15 WHEN 0 THEN 'МЦД-' || (1 + c % 4) WHEN 1 THEN 'метро' ELSE 'Таганско-Краснопресненская' END AS line_prefix
FROM (SELECT k, c, {TEXT} AS t FROM {SQL_BASE}) WHERE k % 15 <= 2 AND NOT (k % 15 = 2 AND contains(right({_COLOURED}, 22), 'мкад'))""",
)
def e20_station_class_requirements(spark, sf):
    out = e.station_classes(normed(spark, sf), ["Сокольническая", "Таганско-Краснопресненская"])
    return out.selectExpr("query_id", "inline_outer(station_class_requirements)").where("line_prefix is not null").select("query_id", "line_prefix")


@query(
    "e22_residuals",
    f"""SELECT k AS query_id, CASE k % 13 WHEN 0 THEN 'широкий балкон' WHEN 1 THEN 'привет' WHEN 2 THEN 'абракадабра' ELSE 'ближайшая сауна' END AS phrase
FROM {SQL_BASE} WHERE k % 13 <= 3 UNION ALL SELECT k, 'не студия' FROM {SQL_BASE} WHERE k % 5 = 3""",
)
def e22_residuals(spark, sf):
    return e.explode_residuals(parse(wishes(spark, sf), YEAR)).select("query_id", "phrase")


@query(
    "p10_residual_class",
    f"""SELECT k AS query_id, CASE k % 13 WHEN 0 THEN 'lost' WHEN 1 THEN 'noise' ELSE 'unknown' END AS class
FROM {SQL_BASE} WHERE k % 13 <= 3 UNION ALL SELECT k, 'lost' FROM {SQL_BASE} WHERE k % 5 = 3""",
)
def p10_residual_class(spark, sf):
    return e.explode_residuals(parse(wishes(spark, sf), YEAR)).select("query_id", "class")


@query(
    "e23_option_candidates",
    f"""SELECT k AS query_id, CASE k % 13 WHEN 0 THEN 'широкий балкон' WHEN 1 THEN 'привет' WHEN 2 THEN 'абракадабра' ELSE 'ближайшая сауна' END AS phrase
FROM {SQL_BASE} WHERE k % 13 <= 3 UNION ALL SELECT k, 'не студия' FROM {SQL_BASE} WHERE k % 5 = 3""",
)
def e23_option_candidates(spark, sf):
    left = e.explode_residuals(parse(wishes(spark, sf), YEAR))
    return left.where("option").select("query_id", "phrase")


SQL_E24 = _q(
    f"""{SQL_ROOMS} AS rooms, {SQL_PRICE_MIN} AS price_min, {SQL_PRICE_MAX} AS price_max, {SQL_AREA_MIN} AS area_min,
 {SQL_KITCHEN} AS area_kitchen_min, {SQL_FLOOR_MIN} AS floor_min, {SQL_FLOOR_MAX} AS floor_max, {SQL_FINISH} AS finish,
 CASE k % 9 WHEN 0 THEN 'price_asc' WHEN 1 THEN 'price_desc' END AS sort, k % 15 = 4 AS center_requested,
 CASE k % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS n_poi,
 ((k % 13 <= 3)::INT + (k % 5 = 3)::INT)::BIGINT AS n_residuals"""
)


@query("e24_assemble_criteria", SQL_E24)
def e24_assemble_criteria(spark, sf):
    out = parse(wishes(spark, sf), YEAR)
    return out.selectExpr(
        "query_id", "array_join(rooms, ',') as rooms", "price_min", "price_max", "area_min", "area_kitchen_min",
        "floor_min", "floor_max", "array_join(transform(finish, f -> cast(f as string)), ',') as finish", "sort",
        "center_requested", "cast(size(poi_requirements) as bigint) as n_poi", "cast(size(residuals) as bigint) as n_residuals",
    )


# Names beside what the rules understand: a complex, a county, a complex with a number, a landmark.
_NAMED = "CASE k % 6 WHEN 0 THEN 'жк ' || p_name WHEN 1 THEN 'округ ' || r_name WHEN 2 THEN 'жк ' || lower(p_type) || ' 24' WHEN 3 THEN 'рядом с плаза ' || lower(r_name) END"
_SQL_NAMED = f"(SELECT k, c, p_name, p_type, r_name FROM {SQL_BASE} JOIN part ON p_partkey = c JOIN region ON r_regionkey = k % 5)"
_FOUND = "CASE k % 6 WHEN 0 THEN p_name WHEN 2 THEN lower(p_type) || ' 24' ELSE '' END AS complexes, CASE WHEN k % 6 = 1 THEN r_name ELSE '' END AS counties, CASE WHEN k % 6 = 3 THEN 'плаза ' || lower(r_name) ELSE '' END AS landmarks"


def _with_names(spark, sf):
    part = table(spark, sf, "part").selectExpr("p_partkey as c", "p_name", "p_type")
    regions = table(spark, sf, "region").select("r_regionkey", "r_name")
    keys = spread(table(spark, sf, "orders").selectExpr("o_orderkey as k", "o_custkey as c"), "k")
    rows = keys.join(part, "c").join(regions, F.expr("k % 5 = r_regionkey"))
    texts = rows.selectExpr("k as query_id", f"concat_ws(', ', {', '.join(PIECES)}, {_NAMED}) as text")
    none = "cast(array() as array<string>) as aliases"
    complexes = table(spark, sf, "part").select(F.explode(F.expr("array(p_name, lower(p_type) || ' 24')")).alias("name")).distinct()
    entries = complexes.selectExpr("1 as ord", "'complex' as type", "name", "name as slug", "name as id", none).unionByName(
        regions.selectExpr("2 as ord", "'county' as type", "r_name as name", "r_name as slug", "r_name as id", none)
    )
    landmarks = regions.selectExpr("r_regionkey as ord", "concat('плаза ', lower(r_name)) as name", none, "55.0D as lat", "37.0D as lon", "'x' as category")
    return texts, entries, landmarks


@query("e24_with_names", SQL_E24.replace(f"FROM {SQL_BASE}", f"FROM {_SQL_NAMED}").replace("SELECT k AS query_id,", f"SELECT k AS query_id, {_FOUND},"))
def e24_with_names(spark, sf):
    texts, entries, landmarks = _with_names(spark, sf)
    out = parse_wishes(texts, YEAR, entries, landmarks)
    return out.selectExpr(
        "query_id", "array_join(transform(complexes, x -> x.name), ',') as complexes", "array_join(transform(counties, x -> x.name), ',') as counties",
        "array_join(transform(coalesce(landmark_requirements, array()), x -> x.name), ',') as landmarks", "array_join(rooms, ',') as rooms",
        "price_min", "price_max", "area_min", "area_kitchen_min", "floor_min", "floor_max", "array_join(transform(finish, f -> cast(f as string)), ',') as finish",
        "sort", "center_requested", "cast(size(poi_requirements) as bigint) as n_poi", "cast(size(residuals) as bigint) as n_residuals",
    )


@query(
    "e2_parse_number",
    _q(
        "(5 + c % 40)::DOUBLE * 1000 + 0.5 AS plain, ((1 + c % 9) * 1000 + 500)::INT AS metres,"
        " (80 * (5 + c % 7))::INT AS walked"
    ),
)
def e2_parse_number(spark, sf):
    from wishgrid.functions.spans import distance_m, number

    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id",
        "concat(5 + o_custkey % 40, ' 000,5') as a",
        "concat('1-', 1 + o_custkey % 9, ',5') as b",
        "concat('3 – ', 5 + o_custkey % 7) as w",
    )
    return rows.selectExpr(
        "query_id", f"{number('a')} as plain", f"{distance_m('b', repr('км'))} as metres",
        f"{distance_m('w', repr('минут'))} as walked",
    )


@query(
    "v1_check_criteria",
    f"""SELECT k AS query_id, field FROM (SELECT k, unnest(list_filter([CASE WHEN k % 4 = 3 THEN 'price_min' END,
  CASE WHEN k % 6 = 1 THEN 'floor_min' END, CASE WHEN k % 10 = 0 THEN 'settlement_year_from' END, CASE WHEN k % 14 IN (0, 13) THEN 'settlement_month_to' END], lambda s: s IS NOT NULL)) AS field FROM {SQL_BASE})""",
)
def v1_check_criteria(spark, sf):
    from wishgrid.operators.audit import check_criteria

    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id", "case when o_orderkey % 4 = 3 then -1 else 5 end as price_min",
        "o_orderkey % 6 - 1 as floor_min_raw", "1990 + cast(o_orderkey % 10 * 10 as int) + case when o_orderkey % 10 > 0 then 10 else 0 end as settlement_year_from",
        "cast(o_orderkey % 14 as int) as settlement_month_to",
    ).selectExpr("query_id", "price_min", "case when floor_min_raw = 0 then 0 when floor_min_raw > 0 then floor_min_raw end as floor_min", "settlement_year_from", "settlement_month_to")
    return check_criteria(rows).select("query_id", "field")
