"""Span operators and corpus audits over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishgrid.functions.spans import arbitrate, gaps_of, match_spans, merge_spans, scan, spans_of, unmarked
from wishgrid.operators import audit
from wishgrid.operators import extract as e
from wishgrid.operators import params
from wishgrid.packs.neutral import RULES
from wishgrid.queries.base import table
from wishgrid.queries.registry import query
from wishgrid.queries.wishes import SQL_BASE, YEAR, wishes
from wishgrid.plans.parse import parse
from wishgrid.session import scratch_path
from wishgrid.sources.catalog import read_corpus

NUMBER = RULES[2]


def docs(spark, sf):
    return (table(spark, sf, "documents")).selectExpr("doc_id", f"{unmarked('text')} as text")


@query(
    "e1_all_match_spans",
    """WITH m AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS hits, regexp_split_to_array(text, '[0-9]+') AS gaps FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM m WHERE len(hits) > 0)
SELECT doc_id, i AS n, hits[i] AS hit, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS s FROM x""",
)
def e1_all_match_spans(spark, sf):
    found = docs(spark, sf).select("doc_id", F.expr(match_spans("text", NUMBER)).alias("m"))
    rows = found.select("doc_id", F.posexplode_outer("m").alias("n", "x")).where("x is not null")
    return rows.selectExpr("doc_id", "cast(n + 1 as bigint) as n", "x.hit as hit", "cast(x.s as bigint) as s")


@query("e0_arbitrate")
def e0_arbitrate(spark, sf):
    """Kept spans of the neutral pack per document; tests check that none overlap."""
    found = docs(spark, sf).select("doc_id", F.expr(arbitrate(scan("text", RULES))).alias("kept"))
    rows = found.select("doc_id", F.explode_outer("kept").alias("k")).where("k is not null")
    return rows.selectExpr("doc_id", "k.rule as rule", "k.s as s", "k.e as e", "k.hit as hit")


@query(
    "e22_uncovered_text",
    "SELECT doc_id, length(regexp_replace(text, '[0-9]+', '', 'g')) AS uncovered, length(text) AS total FROM documents",
)
def e22_uncovered_text(spark, sf):
    found = docs(spark, sf).select("doc_id", "text", F.expr(spans_of(match_spans("text", NUMBER))).alias("c"))
    gaps = found.select("doc_id", "text", F.expr(gaps_of("text", merge_spans("c"))).alias("gaps"))
    return gaps.selectExpr(
        "doc_id", "aggregate(gaps, 0L, (n, g) -> n + g.e - g.s) as uncovered", "cast(length(text) as bigint) as total"
    )


@query(
    "s5_read_corpus",
    """SELECT trim(line) AS text, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents)
WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') GROUP BY 1""",
)
def s5_read_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    lines = table(spark, sf, "documents").selectExpr(r"replace(text, '\r', ' ') as value")
    lines.write.text(path)
    return read_corpus(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


# --- audits: phrases not understood are the runs of digits ---------------------------------------


def _parsed_docs(spark, sf):
    return docs(spark, sf).selectExpr(
        "doc_id as query_id", "text", "regexp_extract_all(text, '[0-9]+', 0) as phrases", "doc_id % 4 as n_fields",
        "case when doc_id % 5 = 0 then 'https://www.pik.ru/search' else 'x' end as link", "doc_id % 17 = 0 as crashed", "doc_id % 3 as n_blocks",
    )


SQL_PARSED = """parsed AS (SELECT doc_id AS query_id, text, regexp_extract_all(text, '[0-9]+') AS phrases, doc_id % 4 AS n_fields, doc_id % 5 = 0 AS bare,
  doc_id % 17 = 0 AS crashed, doc_id % 3 AS n_blocks, len(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) AS words,
  CASE WHEN length(text) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda p: length(p))), 0) / length(text)) END::DOUBLE AS coverage FROM documents)"""


@query("a17_coverage_ratio", f"WITH {SQL_PARSED} SELECT query_id, round(coverage, 6) AS coverage FROM parsed")
def a17_coverage_ratio(spark, sf):
    return _parsed_docs(spark, sf).selectExpr("query_id", f"round({audit.coverage_ratio('text', 'phrases')}, 6) as coverage")


SQL_REPORT = """count(*) AS total_queries, count_if(crashed) AS crashes, count_if(NOT crashed AND bare) AS no_filter_links,
 round(avg(coverage) FILTER (NOT crashed), 6) AS avg_coverage"""


@query(
    "a13_corpus_report",
    f"""WITH {SQL_PARSED} SELECT {SQL_REPORT}, count_if(NOT crashed AND n_fields = 0 AND words > 0) AS empty_criteria,
 count_if(NOT crashed AND n_fields <= 1 AND words > 3) AS near_empty_criteria FROM parsed""",
)
def a13_corpus_report(spark, sf):
    return audit.corpus_report(_parsed_docs(spark, sf)).withColumn("avg_coverage", F.round("avg_coverage", 6))


@query(
    "a16_complex_report",
    f"""WITH {SQL_PARSED} SELECT {SQL_REPORT}, count_if(NOT crashed AND n_blocks = 0) AS without_blocks,
 round(avg(n_fields) FILTER (NOT crashed), 6) AS avg_filter_count FROM parsed""",
)
def a16_complex_report(spark, sf):
    out = audit.complex_report(_parsed_docs(spark, sf))
    return out.withColumn("avg_coverage", F.round("avg_coverage", 6)).withColumn("avg_filter_count", F.round("avg_filter_count", 6))


@query(
    "a13_wish_report",
    f"""SELECT count(*) AS total_queries, 0::BIGINT AS crashes, count_if(k % 5 >= 3 AND k % 4 = 3 AND k % 3 = 2 AND k % 7 > 4 AND k % 6 > 3
 AND k % 11 > 1 AND k % 9 > 1 AND k % 12 > 3 AND k % 14 > 2) AS no_filter_links FROM {SQL_BASE}""",
)
def a13_wish_report(spark, sf):
    """The whole way from wish to link over every wish."""
    parsed = parse(wishes(spark, sf), YEAR)
    none = "cast(array() as array<struct<name:string,slug:string,id:string>>)"
    full = parsed.selectExpr(
        "*", *[f"{none} as {c}" for c in ("metro", "counties", "districts", "complexes")],
        "cast(null as int) as settlement_month_from", "cast(null as int) as settlement_month_to", "cast(null as string) as current_benefit",
        "cast(array() as array<string>) as option_groups", "cast(array() as array<string>) as options",
    )
    linked = params.public_params(full).selectExpr(
        "query_id", "text", "link", "size(params) + size(segments) as n_fields", "transform(residuals, r -> r.text) as phrases",
        "false as crashed",
    )
    return audit.corpus_report(linked).select("total_queries", "crashes", "no_filter_links")


def _warnings(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn as query_id", "concat(role, ' ', conv_id % 50) as text",
        "concat('«', replace(text, '»', ''), '»: ', role, ' ', turn % 3) as warning",
    )


@query(
    "a14_warning_classes",
    """WITH w AS (SELECT conv_id * 1000 + turn AS query_id, role || ' ' || (conv_id % 50) AS text, '«…»: ' || role || ' ' || (turn % 3) AS template
  FROM conversations),
f AS (SELECT template, text, min(query_id) AS q FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY q, text) AS rn FROM f)
SELECT w.template, count(*) AS count, (SELECT string_agg(text, '|' ORDER BY rn) FROM r WHERE r.template = w.template AND rn <= 5) AS examples FROM w GROUP BY w.template""",
)
def a14_warning_classes(spark, sf):
    out = audit.warning_classes(_warnings(spark, sf))
    return out.selectExpr("template", "count", "array_join(examples, '|') as examples")


def _words(spark, sf):
    return docs(spark, sf).selectExpr("explode(split(text, ' ')) as phrase")


SQL_PHRASES = """p AS (SELECT lower(trim(w, ' ,.-:;!?()')) AS phrase FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)),
c AS (SELECT phrase, count(*) AS count FROM p WHERE phrase <> '' GROUP BY phrase)"""


@query("a15_top_residuals", f"WITH {SQL_PHRASES} SELECT * FROM c ORDER BY count DESC, phrase LIMIT 30")
def a15_top_residuals(spark, sf):
    return audit.top_residuals(_words(spark, sf))


@query("a15_orphans", f"WITH {SQL_PHRASES} SELECT * FROM c WHERE length(phrase) <= 2")
def a15_orphans(spark, sf):
    return audit.orphans(_words(spark, sf))


@query(
    "e25_open_fragments",
    f"""SELECT k AS query_id, CASE WHEN k % 3 = 0 THEN 'Добрый  день!' WHEN k % 3 = 1 THEN 'балкон ' || c END AS fragment FROM {SQL_BASE} WHERE k % 3 = 1""",
)
def e25_open_fragments(spark, sf):
    from wishgrid.packs.russian import GREETINGS
    from wishgrid.session import fixed_table

    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id", "0 as seq",
        "case o_orderkey % 3 when 0 then '«Добрый  день!»: не удалось распознать, не попало в ссылку'"
        " when 1 then concat('«балкон ', o_custkey, '»: не удалось распознать, не попало в ссылку') else '«x»: other' end as warning",
    )
    greetings = fixed_table(spark, [(g,) for g in GREETINGS], "greeting string")
    return audit.open_fragments(rows, greetings).select("query_id", "fragment")


@query(
    "p17_describe_unmet",
    f"""SELECT k AS query_id, array_to_string(list_filter([CASE WHEN k % 8 IN (0, 3) THEN 'school' WHEN k % 8 = 1 THEN 'park_forest' WHEN k % 8 = 2 THEN 'kindergarten new' END,
  CASE WHEN k % 8 = 3 THEN 'medical' END, CASE WHEN k % 15 = 4 THEN 'centre' END], lambda s: s IS NOT NULL), '; ') AS unmet FROM {SQL_BASE}""",
)
def p17_describe_unmet(spark, sf):
    from wishgrid.queries.wishes import normed

    found = e.poi_requirements(normed(spark, sf))
    named = found.withColumn(
        "poi_requirements",
        F.expr("transform(poi_requirements, r -> named_struct('raw_phrase', concat(r.category, case when r.only_new then ' new' else '' end), 'only_new', r.only_new, 'max_distance_m', r.max_distance_m))"),
    )
    out = audit.describe_unmet(named)
    return out.selectExpr("query_id", "array_join(transform(unmet, u -> replace(u.phrase, 'в центре', 'centre')), '; ') as unmet")


MARKERS = ["the", "der", "les", "que", "license", "@"]


@query(
    "p18_marker_tags",
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN '{m}' END" for m in MARKERS)
    + "], lambda s: s IS NOT NULL), ',') AS tags FROM documents",
)
def p18_marker_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(audit.marker_tags(F.col("text"), MARKERS), ",").alias("tags"))


@query(
    "j19_derive_names",
    """WITH v AS (SELECT o_custkey AS group_id, c.c_mktsegment AS county, count(*) AS n, min(o_orderkey) AS f FROM orders JOIN customer c ON c.c_custkey = o_orderkey % 1000 WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL)
SELECT o.o_custkey AS group_id, count(*) AS members, (SELECT arg_max(county, (n, -f)) FROM v WHERE v.group_id = o.o_custkey) AS best_name,
 coalesce((SELECT count(*) FROM v WHERE v.group_id = o.o_custkey), 0) AS names, coalesce((SELECT sum(n)::BIGINT FROM v WHERE v.group_id = o.o_custkey), 0) AS named FROM orders o GROUP BY o.o_custkey""",
)
def j19_derive_names(spark, sf):
    groups = table(spark, sf, "orders").selectExpr("o_custkey as group_id", "o_orderkey as pos", "o_orderkey % 1000 as member_id")
    members = table(spark, sf, "customer").selectExpr("c_custkey as member_id", "case when c_mktsegment <> 'MACHINERY' then c_mktsegment end as county")
    return audit.derive_names(groups, members)


SQL_FOUND = """found AS (SELECT p_size AS query_pos, p_partkey AS item_pos, upper(p_name) || p_size AS full_name, floor(p_retailprice)::BIGINT AS stars FROM part),
known AS (SELECT DISTINCT p_name || p_size AS full_name FROM part JOIN supplier ON s_suppkey = p_partkey)"""


def _found(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_size as query_pos", "p_partkey as item_pos", "concat(upper(p_name), p_size) as full_name", "cast(floor(p_retailprice) as bigint) as stars"
    )


def _known(spark, sf):
    part = table(spark, sf, "part")
    return part.join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("p_partkey")).selectExpr("concat(p_name, p_size) as full_name")


@query(
    "j20_new_candidates",
    f"""WITH {SQL_FOUND} SELECT full_name, arg_min(stars, (query_pos, item_pos)) AS stars, min(query_pos)::INT AS query_pos FROM found
WHERE lower(full_name) NOT IN (SELECT lower(full_name) FROM known) GROUP BY full_name""",
)
def j20_new_candidates(spark, sf):
    return audit.new_candidates(_found(spark, sf), _known(spark, sf))


@query(
    "j24_curated_facts",
    f"""WITH {SQL_FOUND}, meta AS (SELECT lower(full_name) AS k, min(stars) AS stars FROM found GROUP BY 1)
SELECT s_name AS category, full_name, stars FROM (SELECT s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE p_name || p_size END AS full_name FROM supplier JOIN part ON p_partkey = s_suppkey) c JOIN meta ON k = lower(full_name)""",
)
def j24_curated_facts(spark, sf):
    curated = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("s_suppkey")).selectExpr(
        "s_name as category", "case when s_suppkey % 3 = 0 then s_name else concat(p_name, p_size) end as full_name"
    )
    meta = _found(spark, sf).groupBy(F.lower("full_name").alias("full_name")).agg(F.min("stars").alias("stars"))
    return audit.curated_facts(curated, meta)[0]


@query(
    "j24_missing_metadata",
    "SELECT s_name AS full_name FROM supplier WHERE s_suppkey % 3 = 0",
)
def j24_missing_metadata(spark, sf):
    curated = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("s_suppkey")).selectExpr(
        "s_name as category", "case when s_suppkey % 3 = 0 then s_name else concat(p_name, p_size) end as full_name"
    )
    meta = _found(spark, sf).groupBy(F.lower("full_name").alias("full_name")).agg(F.min("stars").alias("stars"))
    return audit.curated_facts(curated, meta)[1].select("full_name")
