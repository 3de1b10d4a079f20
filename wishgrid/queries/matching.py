"""Similarity, gazetteer and vector operators over parts, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishgrid.functions.text import char_masks, normalize_chars, normalize_key, similarity
from wishgrid.operators import gazetteer as gz
from wishgrid.operators import vectors
from wishgrid.operators.similar import similar_pairs
from wishgrid.queries.base import spread, sql_key, table, with_sql
from wishgrid.queries.catalog import sql_similarity
from wishgrid.queries.registry import query

# Labels of parts and of parts with one or two letters changed.
SQL_FORMS = """names AS (SELECT DISTINCT p_name || ' ' || p_size AS b FROM part),
forms AS (SELECT DISTINCT replace(p_name, substring(p_name, (p_partkey % 5 + 1)::INT, 1), CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'q' END) || ' ' || p_size AS a FROM part)"""


def _names(spark, sf):
    return table(spark, sf, "part").selectExpr("concat_ws(' ', p_name, p_size) as b").distinct()


def _forms(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat_ws(' ', replace(p_name, substring(p_name, cast(p_partkey % 5 + 1 as int), 1), case when p_partkey % 2 = 0 then '' else 'q' end), p_size) as a"
    ).distinct()


@query(
    "f2_similarity",
    f"SELECT p_partkey AS id, round({sql_similarity('a', 'b')}, 4) AS score FROM (SELECT p_partkey, p_name AS a, p_type || ' ' || p_brand AS b FROM part)",
)
def f2_similarity(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey as id", "p_name as a", "concat(p_type, ' ', p_brand) as b")
    masked = rows.withColumn("m", char_masks(F.col("a")))
    return masked.select("id", F.round(similarity(F.col("a"), F.col("b"), F.col("m")), 4).alias("score"))


@query(
    "f2_similar_pairs",
    with_sql(SQL_FORMS)
    + f"SELECT a, b, round(score, 4) AS score FROM (SELECT a, b, CASE WHEN a = b THEN 100.0 ELSE {sql_similarity('a', 'b')} END AS score FROM forms JOIN names ON abs(length(a) - length(b)) <= 4) WHERE score >= 88 - 1e-9",
)
def f2_similar_pairs(spark, sf):
    return similar_pairs(_forms(spark, sf), _names(spark, sf), 88.0).withColumn("score", F.round("score", 4))


SQL_NAMES = "names AS (SELECT DISTINCT p_name AS b FROM part), forms AS (SELECT DISTINCT n_name || ' ' || r_name AS a FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT p_name || 's' FROM part)"


@query(
    "f9_nearest_forms",
    with_sql(SQL_NAMES)
    + f"""SELECT a, b, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank
 FROM (SELECT a, b, {sql_similarity('a', 'b')} AS score FROM forms, names) WHERE score > 0) WHERE rank <= 5""",
)
def f9_nearest_forms(spark, sf):
    names = table(spark, sf, "part").selectExpr("p_name as b").distinct()
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    forms = places.selectExpr("concat_ws(' ', n_name, r_name) as a").union(table(spark, sf, "part").selectExpr("concat(p_name, 's') as a")).distinct()
    out = gz.nearest_forms(forms, names, 5)
    return out.selectExpr("a", "b", "round(score, 4) as score", "cast(rank as bigint) as rank")


# --- names in texts: an order asks for the label of a part ------------------------------------------

_PART = "list_max(list_transform(range(2 - length({s}), length({l}) + 1), lambda q: {sim}))"


def _sql_partial(a: str, b: str) -> str:
    short = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)"
    long = f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    first, last = "greatest(q, 1)", f"least(q + length({short}) - 1, length({long}))"
    piece = f"substring({long}, {first}::INT, ({last} - {first} + 1)::INT)"
    best = _PART.format(s=short, l=long, sim=sql_similarity(short, piece))
    return f"(CASE WHEN length({short}) = 0 THEN 0.0 WHEN contains({long}, {short}) THEN 100.0 ELSE {best} END)"


#: ``pairs(a, b)`` -> ``composite(a, b, ratio, score)`` over every pair.
SQL_COMPOSITE = f"""tokens AS (SELECT a, b, list_sort(string_split(a, ' ')) AS x, list_sort(string_split(b, ' ')) AS y FROM pairs),
sets AS (SELECT a, b, array_to_string(x, ' ') AS sa, array_to_string(y, ' ') AS sb,
  array_to_string(list_filter(list_distinct(x), lambda t: list_contains(y, t)), ' ') AS w,
  array_to_string(list_sort(list_filter(list_distinct(x), lambda t: NOT list_contains(y, t))), ' ') AS ra,
  array_to_string(list_sort(list_filter(list_distinct(y), lambda t: NOT list_contains(x, t))), ' ') AS rb FROM tokens),
measured AS (SELECT *, CASE WHEN a = b THEN 100.0 ELSE {sql_similarity('a', 'b')} END AS ratio, CASE WHEN sa = sb THEN 100.0 ELSE {sql_similarity('sa', 'sb')} END AS by_sort,
  CASE WHEN ra = '' OR rb = '' THEN 0.0 ELSE {sql_similarity('ra', 'rb')} * (length(ra) + length(rb)) / 200.0 END AS common, (w <> '')::INT AS gap,
  greatest(length(a), length(b)) / least(length(a), length(b)) AS times FROM sets WHERE a <> '' AND b <> ''),
worded AS (SELECT *, CASE WHEN w <> '' AND (ra = '' OR rb = '') THEN 100.0 ELSE greatest(
  200.0 * (length(w) + gap + common) / (2 * (length(w) + gap) + length(ra) + length(rb)),
  CASE WHEN w <> '' THEN 200.0 * length(w) / (2 * length(w) + 1 + least(length(ra), length(rb))) ELSE 0.0 END) END AS by_set FROM measured),
composite AS (SELECT a, b, ratio, greatest(ratio, CASE WHEN a = b THEN 100.0 WHEN times < 1.5 THEN 0.95 * greatest(by_sort, by_set)
  ELSE (CASE WHEN times <= 8 THEN 0.9 ELSE 0.6 END) * greatest({_sql_partial('a', 'b')}, 0.95 * CASE WHEN w <> '' THEN 100.0 ELSE {_sql_partial('sa', 'sb')} END) END) AS score FROM worded)"""

SQL_COVER = f"""entries AS (SELECT min(p_partkey) AS ord, p_name AS slug, {sql_key('p_name')} AS b FROM part GROUP BY p_name),
asked AS (SELECT DISTINCT p_name AS own, {sql_key("replace(p_name, substring(p_name, (p_partkey % 5 + 1)::INT, 1), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'qq' END)")} AS a FROM part),
fresh AS (SELECT * FROM asked WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.slug = own AND e.b = a) AND a <> ''),
pairs AS (SELECT DISTINCT f.a, e.b FROM fresh f, entries e),
{SQL_COMPOSITE},
best AS (SELECT * FROM (SELECT a, arg_max(slug, (score, -ord)) AS slug, max(score) AS score, arg_max(ratio, (score, -ord)) AS ratio
  FROM composite JOIN entries USING (b) WHERE score >= 88 - 1e-9 GROUP BY a) WHERE ratio >= 88 - 1e-9)"""


@query(
    "f8_alias_coverage",
    with_sql(SQL_COVER)
    + """SELECT own AS slug, f.a AS form, round(score, 4) AS score, CASE WHEN b.slug = own THEN 'ok' WHEN b.slug IS NOT NULL OR EXISTS (SELECT 1 FROM entries e WHERE e.b = f.a AND e.slug <> own)
 THEN 'collision' ELSE 'missing' END AS status FROM fresh f LEFT JOIN best b ON b.a = f.a""",
)
def f8_alias_coverage(spark, sf):
    part = table(spark, sf, "part")
    entries = part.groupBy("p_name").agg(F.min("p_partkey").alias("ord")).selectExpr(
        "ord", "p_name as slug", "p_name as name", "cast(array() as array<string>) as aliases"
    )
    forms = part.selectExpr(
        "p_name as slug", "replace(p_name, substring(p_name, cast(p_partkey % 5 + 1 as int), 1), case when p_partkey % 3 = 0 then '' else 'qq' end) as form"
    )
    out = gz.alias_coverage(entries, forms)
    return out.selectExpr("slug", "form", "round(score, 4) as score", "status")


# What is asked: the name, near names, its first word, its words turned round with another, a foreign name.
_ASKED = [
    "p_name", "p_name || 's'", "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)",
    "replace(p_name, substring(p_name, 2, 1), '')", "split_part(p_name, ' ', 2) || ' дом'", "'абвгд'",
]
_SQL_ASKED = " UNION ".join(f"SELECT {f} AS a FROM part" for f in _ASKED)


@query(
    "f1_composite_scores",
    with_sql("names AS (SELECT DISTINCT p_name AS b FROM part UNION SELECT DISTINCT p_name || ' ' || lower(p_type) FROM part)", f"asked AS ({_SQL_ASKED})", "pairs AS (SELECT a, b FROM asked, names)", SQL_COMPOSITE)
    + "SELECT a, b, round(ratio, 4) AS ratio, round(score, 4) AS score FROM composite WHERE score >= 75 - 1e-9",
)
def f1_composite_scores(spark, sf):
    part = table(spark, sf, "part")
    forms = [f.replace("split_part(p_name, ' ', 1)", "split(p_name, ' ')[0]").replace("split_part(p_name, ' ', 2)", "split(p_name, ' ')[1]") for f in _ASKED]
    asked = part.select(F.explode(F.array(*(F.expr(f) for f in forms))).alias("a")).distinct().withColumn("kinds", F.array(F.lit("complex")))
    names = part.select(F.explode(F.expr("array(p_name, p_name || ' ' || lower(p_type))")).alias("b")).distinct().withColumn("kind", F.lit("complex"))
    out = gz.composite_pairs(asked, names, 75.0)
    return out.select("a", "b", F.round("ratio", 4).alias("ratio"), F.round("score", 4).alias("score"))


def _entries(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord")).selectExpr(
        "ord", "'complex' as type", "p_name as name", "concat('s', ord) as slug", "concat('i', ord) as id", "cast(array() as array<string>) as aliases"
    )


# An order asks for the name after a marker or without one, for a near name, for a part of it, for a foreign one.
_FORM = """CASE k % 6 WHEN 2 THEN {name} || 's' WHEN 3 THEN {first} WHEN 4 THEN 'абвгд' ELSE {name} END"""
_BEFORE = "CASE k % 6 WHEN 0 THEN 'хочу жк ' WHEN 1 THEN 'ищу квартиру, ' ELSE 'в жк ' END"


def _asking(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    orders = spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), "k")
    rows = orders.join(part, F.col("p_partkey") == F.col("o_custkey"))
    form = _FORM.format(name="p_name", first="split(p_name, ' ')[0]")
    return rows.selectExpr("k as query_id", f"concat({_BEFORE}, {form}, case when k % 2 = 0 then ', недорого' else '' end) as text")


_SQL_FOUND = with_sql(
    "names AS (SELECT p_name AS b, min(p_partkey) AS ord FROM part GROUP BY 1)",
    "asks AS (SELECT o_orderkey AS k, " + _FORM.format(name="p_name", first="split_part(p_name, ' ', 1)").replace("k % 6", "o_orderkey % 6") + " AS a FROM orders JOIN part ON p_partkey = o_custkey)",
    "pairs AS (SELECT a, b FROM (SELECT DISTINCT a FROM asks), names)",
    SQL_COMPOSITE,
    "best AS (SELECT a, arg_max(b, (score + ratio / 1000, -ord)) AS name, max(score + ratio / 1000) AS score FROM composite JOIN names USING (b) WHERE score >= 75 - 1e-9 GROUP BY a)",
)


@query(
    "f1_match_gazetteer",
    _SQL_FOUND + "SELECT k AS query_id, name, round(score, 4) AS score FROM asks JOIN best USING (a)",
)
def f1_match_gazetteer(spark, sf):
    found = gz.named_entities(_asking(spark, sf), _entries(spark, sf))
    return found.select("query_id", "name", F.round("score", 4).alias("score"))


@query(
    "f7_resolve_overlaps",
    _SQL_FOUND
    + f"""SELECT k AS query_id, name, CASE k % 6 WHEN 0 THEN length({_BEFORE}) - 3 WHEN 1 THEN length({_BEFORE}) ELSE 0 END::INT AS s, (length({_BEFORE}) + length(a))::INT AS e, false AS ambiguous
FROM asks JOIN best USING (a)""",
)
def f7_resolve_overlaps(spark, sf):
    found = gz.named_entities(_asking(spark, sf), _entries(spark, sf))
    return found.select("query_id", "name", "s", "e", "ambiguous")


@query(
    "f4_trigger_type",
    "SELECT o_orderkey AS query_id, CASE o_orderkey % 4 WHEN 0 THEN 'metro' WHEN 1 THEN 'district' WHEN 2 THEN 'complex' END AS type, CASE o_orderkey % 4 WHEN 0 THEN 6 + length(o_custkey::VARCHAR) WHEN 1 THEN 6 + length(o_custkey::VARCHAR) WHEN 2 THEN 6 + length(o_custkey::VARCHAR) END::INT AS s FROM orders",
)
def f4_trigger_type(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id",
        "concat('wish ', o_custkey, case o_orderkey % 4 when 0 then ' рядом с метро ' when 1 then ' в районе ' when 2 then ' в ЖК ' else ' дом ' end) as before",
    ).withColumn("before_norm", normalize_chars("before"))
    return rows.select("query_id", gz.trigger_type().alias("t")).selectExpr("query_id", "t.type as type", "t.s as s")


@query(
    "f3_context_score",
    """SELECT o_orderkey AS query_id, CASE o_orderkey % 4 WHEN 0 THEN 10.3 WHEN 1 THEN 5.4 WHEN 2 THEN 15.2 ELSE 0.0 END::DOUBLE AS score FROM orders""",
)
def f3_context_score(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id",
        "case o_orderkey % 4 when 0 then 'у метро' when 1 then 'хочу на' when 2 then 'жк в' else 'дом' end as before",
        "case o_orderkey % 4 when 0 then 'metro' when 1 then 'district' when 2 then 'complex' else 'option_groups' end as type",
        "array(concat('имя', o_custkey)) as tokens", "array(concat('имя', o_custkey, ' x')) as names",
    ).withColumn("last", F.split("before", " "))
    return rows.select("query_id", F.round(gz.context_score(), 4).alias("score"))


@query(
    "f5_modifier_conflict",
    "SELECT o_orderkey AS query_id, o_orderkey % 4 IN (1, 2) AS conflict FROM orders",
)
def f5_modifier_conflict(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id",
        "case o_orderkey % 4 when 0 then 'зимнего парка' when 1 then 'парк' when 2 then 'зеленый парк' else 'кухня' end as a", "'зимний парк' as b",
    )
    return rows.select("query_id", gz.modifier_conflict().alias("conflict"))


@query(
    "f6_needs_marker",
    "SELECT o_orderkey AS query_id, o_orderkey % 3 = 0 AS needs FROM orders",
)
def f6_needs_marker(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id", "'metro' as type", "case when o_orderkey % 3 = 2 then 'сокол' else 'аэропорт' end as a",
        "case when o_orderkey % 3 = 2 then 'сокол' else 'аэропорт' end as name_key", "case when o_orderkey % 3 = 1 then 'у метро' else 'рядом' end as before",
        "'Аэропорт' as window_text",
    ).selectExpr("*", "length(before) + 1 as at", "instr(lower(before), 'м.') as dot_at", f"{gz.marker_end('before')} as mark_at")
    return rows.select("query_id", gz.needs_marker().alias("needs"))


@query(
    "e18_landmark_requirements",
    """SELECT o_orderkey AS query_id, p_name AS name, o_orderkey % 3 = 0 AS nearest_only, CASE WHEN o_orderkey % 2 = 0 THEN (1 + o_custkey % 5) * 1000 END::INT AS max_distance_m
FROM orders JOIN part ON p_partkey = o_custkey""",
)
def e18_landmark_requirements(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    orders = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    rows = orders.join(part, F.col("p_partkey") == F.col("o_custkey")).selectExpr(
        "o_orderkey as query_id",
        "concat(case when o_orderkey % 3 = 0 then 'как можно ближе к ' else 'дом рядом с ' end, p_name, case when o_orderkey % 2 = 0 then concat(' не дальше ', 1 + o_custkey % 5, ' км') else '' end) as text",
    ).withColumn("norm", normalize_chars("text"))
    landmarks = _entries(spark, sf).selectExpr("ord", "name", "aliases", "55.0D as lat", "37.0D as lon", "'x' as category")
    return gz.landmark_requirements(rows, landmarks).select("query_id", "name", "nearest_only", "max_distance_m")


@query(
    "e21_entity_number_spans",
    "SELECT c_custkey AS query_id, 3 AS s, (3 + length(p_name) + 1 + length(p_size::VARCHAR))::INT AS e FROM customer JOIN part ON p_partkey = c_custkey",
)
def e21_entity_number_spans(spark, sf):
    part = table(spark, sf, "part").selectExpr("p_partkey", "concat_ws(' ', p_name, p_size) as label")
    asks = (table(spark, sf, "customer").join(part, F.col("p_partkey") == F.col("c_custkey"))).selectExpr(
        "c_custkey as query_id", "concat('ab ', label) as text"
    )
    entries = part.groupBy("label").agg(F.min("p_partkey").alias("ord")).selectExpr(
        "ord", "'complex' as type", "label as name", "cast(null as string) as slug", "cast(null as string) as id", "cast(array() as array<string>) as aliases"
    )
    spans = gz.entity_number_spans(gz.named_entities(asks, entries), asks)
    return spans.selectExpr("query_id", "reserved[0].s as s", "reserved[0].e as e")


# --- vectors -----------------------------------------------------------------------------------------

DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_AB, _AA, _BB = DOT.format(a="q.embedding", b="c.embedding"), DOT.format(a="q.embedding", b="q.embedding"), DOT.format(a="c.embedding", b="c.embedding")


def _lookup_sql(threshold: float) -> str:
    return f"""SELECT query_id, id, round(dist, 4) AS dist FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, 1 - {_AB} / (sqrt({_AA}) * sqrt({_BB})) AS dist
 FROM embeddings q JOIN embeddings c ON q.vec_id % 2 = 0 AND c.vec_id % 2 = 1) WHERE dist <= {threshold}
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) = 1"""


def _halves(spark, sf):
    e = table(spark, sf, "embeddings")
    return (
        e.where("vec_id % 2 = 0").selectExpr("vec_id as query_id", "embedding"),
        e.where("vec_id % 2 = 1").selectExpr("vec_id as id", "embedding"),
    )


@query("f10_semantic_lookup", _lookup_sql(0.6))
def f10_semantic_lookup(spark, sf):
    asked, cache = _halves(spark, sf)
    return vectors.semantic_lookup(asked, cache, 0.6, 64).withColumn("dist", F.round("dist", 4))


@query("f10_semantic_lookup_wide", _lookup_sql(0.65))
def f10_semantic_lookup_wide(spark, sf):
    asked, cache = _halves(spark, sf)
    return vectors.semantic_lookup(asked, cache, 0.65, 64).withColumn("dist", F.round("dist", 4))


@query(
    "f11_touch_cache",
    """SELECT p_partkey AS id, p_size + coalesce(n, 0) AS hit_count, strftime(coalesce(u, TIMESTAMP '2020-01-01'), '%Y-%m-%d') AS last_used_at
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS u FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey""",
)
def f11_touch_cache(spark, sf):
    cache = table(spark, sf, "part").selectExpr("p_partkey as id", "cast(p_size as bigint) as hit_count", "cast('2020-01-01' as timestamp_ntz) as last_used_at")
    hits = table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("l_partkey as id", "l_shipdate as used_at")
    return vectors.touch_cache(cache, hits).selectExpr("id", "hit_count", "date_format(last_used_at, 'yyyy-MM-dd') as last_used_at")


@query(
    "f12_store_cache",
    "SELECT query_signature, count(*) AS n FROM (SELECT p_type AS query_signature FROM part UNION ALL SELECT p_type FROM part JOIN supplier ON s_suppkey = p_partkey) GROUP BY 1",
)
def f12_store_cache(spark, sf):
    part = table(spark, sf, "part")
    cache = part.selectExpr("p_type as query_signature", "p_size as hit_count")
    news = part.join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("p_partkey")).selectExpr("p_type as query_signature")
    return vectors.store_cache(cache, news).groupBy("query_signature").agg(F.count(F.lit(1)).alias("n"))
