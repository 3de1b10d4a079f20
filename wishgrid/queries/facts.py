"""Fact and call-log operators over ``events`` (observations and log rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishgrid.operators import facts, usage
from wishgrid.queries.base import SQL_PLACES, places, table, with_sql
from wishgrid.queries.registry import query
from wishgrid.sources.call_log import last_days, read_call_log, write_call_log
from wishgrid.session import scratch_path

K = "cast(get_json_object(props, '$.k') as int)"
SQL_K = "CAST(json_extract_string(props, '$.k') AS INT)"


def observations(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "'user' as subject_type",
        "cast(user_id as string) as subject_id",
        "event_type as fact_type",
        f"concat('{{\"v\":', {K} % 2, '}}') as fact_value",
        "case when value > 400 then 'promoted' else 'ai_inference' end as source",
        "value / 500 as confidence",
        "ts as observed_at",
        "event_id as event_order",
    )


SQL_OBS = f"""obs AS (
  SELECT 'user' AS subject_type, user_id::VARCHAR AS subject_id, event_type AS fact_type,
         '{{"v":' || ({SQL_K} % 2) || '}}' AS fact_value,
         CASE WHEN value > 400 THEN 'promoted' ELSE 'ai_inference' END AS source,
         value / 500 AS confidence, ts AS observed_at, event_id AS event_order FROM events)"""

SQL_FOLDED = """marked AS (
  SELECT *, CASE WHEN lag(fact_value) OVER w <> fact_value THEN 1 ELSE 0 END AS changed
  FROM obs WINDOW w AS (PARTITION BY subject_type, subject_id, fact_type ORDER BY observed_at, event_order)),
runs AS (
  SELECT *, sum(changed) OVER (PARTITION BY subject_type, subject_id, fact_type
                               ORDER BY observed_at, event_order) AS run FROM marked),
folded AS (
  SELECT subject_type, subject_id, fact_type, arg_max(fact_value, (observed_at, event_order)) AS fact_value,
         arg_max(source, (observed_at, event_order)) AS source,
         max(confidence) FILTER (run = last_run) AS confidence,
         count(*) AS observed_count, sum(changed)::BIGINT AS conflicts,
         min(observed_at) AS first_seen_at, max(observed_at) AS last_confirmed_at
  FROM (SELECT *, max(run) OVER (PARTITION BY subject_type, subject_id, fact_type) AS last_run FROM runs)
  GROUP BY subject_type, subject_id, fact_type)"""

STAMP = "date_format({0}, 'yyyy-MM-dd HH:mm:ss') as {0}"
SQL_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def _stamped(df, *names):
    rest = [c for c in df.columns if c not in names]
    return df.selectExpr(*rest, *[STAMP.format(n) for n in names])


@query(
    "a4_fold_facts",
    with_sql(SQL_OBS, SQL_FOLDED)
    + f"""SELECT subject_type, subject_id, fact_type, fact_value, source,
 round(confidence, 4) AS confidence, observed_count, conflicts,
 {SQL_STAMP.format('first_seen_at')}, {SQL_STAMP.format('last_confirmed_at')} FROM folded""",
)
def a4_fold_facts(spark, sf):
    folded = facts.fold_facts(observations(spark, sf))
    return _stamped(
        folded.withColumn("confidence", F.round("confidence", 4)), "first_seen_at", "last_confirmed_at"
    )


@query(
    "a5_promotable_facts",
    with_sql(SQL_OBS, SQL_FOLDED)
    + """SELECT subject_id, fact_type, fact_value, observed_count FROM folded
WHERE observed_count >= 5 AND confidence >= 0.1 AND source <> 'promoted'""",
)
def a5_promotable_facts(spark, sf):
    kept = facts.promotable_facts(facts.fold_facts(observations(spark, sf)), 5, 0.1)
    return kept.select("subject_id", "fact_type", "fact_value", "observed_count")


# Areas of A6 are the nations; a user id names the nation with the same key.
@query(
    "a6_promote_centre",
    with_sql(SQL_OBS, SQL_FOLDED)
    + """SELECT n.n_nationkey::VARCHAR AS id, n.n_name AS name,
 CASE WHEN f.subject_id IS NOT NULL THEN f.fact_value = '{"v":1}' ELSE n.n_nationkey % 3 = 0 END AS is_center
FROM nation n LEFT JOIN folded f ON f.fact_type = 'click' AND f.subject_id = n.n_nationkey::VARCHAR""",
)
def a6_promote_centre(spark, sf):
    said = (
        facts.fold_facts(observations(spark, sf))
        .where("fact_type = 'click'")
        .selectExpr(
            "'county' as subject_type",
            "subject_id",
            "'is_center' as fact_type",
            "case when fact_value = '{\"v\":1}' then '{\"is_center\":true}' else '{\"is_center\":false}' end as fact_value",
        )
    )
    areas = table(spark, sf, "nation").selectExpr(
        "'county' as kind",
        "cast(n_nationkey as string) as id",
        "n_name as name",
        "n_nationkey % 3 = 0 as is_center",
    )
    return facts.promote_centre(said, areas).select("id", "name", "is_center")


# Presence facts of A7: user id = supplier key, event type = category; measured rows come from
# the parts with the same key.
@query(
    "a7_promote_poi",
    with_sql(SQL_OBS, SQL_FOLDED)
    + """SELECT 'b' || subject_id AS subject_id, 'poi_' || fact_type AS fact_type,
 CASE WHEN s_suppkey IS NULL THEN 'ignored' WHEN p_partkey IS NULL THEN 'inserted'
      WHEN (CASE WHEN p_partkey % 2 = 0 THEN p_size % 4 > 0 ELSE p_size % 3 > 0 END) = (fact_value = '{"v":1}')
      THEN 'agreed' ELSE 'rejected' END AS outcome
FROM folded LEFT JOIN supplier ON s_suppkey::VARCHAR = subject_id
LEFT JOIN part ON p_partkey = s_suppkey AND fact_type IN ('view', 'click')""",
)
def a7_promote_poi(spark, sf):
    said = facts.fold_facts(observations(spark, sf)).selectExpr(
        "'complex' as subject_type",
        "concat('b', subject_id) as subject_id",
        "concat('poi_', fact_type) as fact_type",
        "case when fact_value = '{\"v\":1}' then '{\"present\":true}' else '{\"present\":false}' end as fact_value",
    )
    complexes = places(spark, sf).selectExpr("place_id as id", "slug")
    poi = table(spark, sf, "part").selectExpr(
        "concat('c', p_partkey) as slug",
        "explode(array('view', 'click')) as category",
        "p_size % 3 as count",
        "p_size % 4 as count_operational",
        "case when p_partkey % 2 = 0 then 2 else 1 end as schema_version",
    )
    return facts.promote_poi(said, complexes, poi).select("subject_id", "fact_type", "outcome")


# Alias facts: every folded fact is a vote of its user for a phrase (two event types share one).
SQL_ALIAS = """alias_facts AS (
  SELECT row_number() OVER (ORDER BY subject_id, fact_type) AS fact_id, 'option' AS subject_type,
         fact_type AS slug, 'Phrase  ' || (subject_id::INT % 40) AS phrase, observed_count,
         confidence, source, subject_id FROM folded WHERE fact_type IN ('view', 'click', 'signup')
         AND (subject_id::INT % 3 = 0 OR fact_type = 'view')),
votes AS (
  SELECT lower(regexp_replace(phrase, '\\s+', ' ')) AS phrase, slug,
         sum(observed_count)::BIGINT AS votes, max(confidence) AS confidence, min(fact_id) AS first_id
  FROM alias_facts GROUP BY ALL),
tops AS (
  SELECT *, sum(votes) OVER (PARTITION BY phrase)::BIGINT AS total, count(*) OVER (PARTITION BY phrase) AS slugs,
         row_number() OVER (PARTITION BY phrase ORDER BY votes DESC, first_id) AS rn FROM votes),
outcome AS (
  SELECT translate(phrase, 'ёabcehkmoptxy', 'еавсенкмортху') AS phrase, slug, votes, total, slugs,
         CASE WHEN slugs > 1 AND votes / total < 0.6 THEN 'ambiguous'
              WHEN votes >= 40 AND confidence >= 0.2 THEN 'promotable' ELSE 'silent' END AS status
  FROM tops WHERE rn = 1)"""


def _alias_facts(spark, sf):
    folded = facts.fold_facts(observations(spark, sf)).where(
        "fact_type in ('view', 'click', 'signup') and (cast(subject_id as int) % 3 = 0 or fact_type = 'view')"
    )
    # The order of the ids only decides ties; any order-preserving number of the key will do.
    return folded.selectExpr(
        "concat(subject_id, ' ', fact_type) as fact_key",
        "'option' as subject_type",
        "fact_type as subject_id",
        "concat('Phrase  ', cast(subject_id as int) % 40) as phrase",
        "observed_count",
        "confidence",
        "source",
    )


def _votes(spark, sf):
    rows = _alias_facts(spark, sf)
    ids = rows.selectExpr("*", "conv(substring(md5(fact_key), 1, 15), 16, 10) as h").selectExpr(
        "*", "cast(h as bigint) as fact_id"
    )
    return facts.alias_votes(ids, 40, 0.2, 0.6)


@query(
    "a8_alias_votes",
    with_sql(SQL_OBS, SQL_FOLDED, SQL_ALIAS)
    + "SELECT phrase, votes, total, slugs, status FROM outcome",
)
def a8_alias_votes(spark, sf):
    return _votes(spark, sf).select("phrase", "votes", "total", "slugs", "status")


@query(
    "a9_apply_aliases",
    with_sql(SQL_OBS, SQL_FOLDED, SQL_ALIAS)
    + """SELECT e.slug, e.ord, len(e.aliases) + CASE WHEN e.first THEN
   (SELECT count(*) FROM outcome o WHERE o.status = 'promotable' AND o.slug = e.slug
     AND o.phrase <> 'рнrаsе 1') ELSE 0 END AS n_aliases
FROM (SELECT p_partkey AS ord, ['view', 'click', 'signup', 'purchase'][(p_partkey % 4 + 1)::INT] AS slug,
        ['Phrase 1', p_type] AS aliases, p_partkey < 4 AS first FROM part) e""",
)
def a9_apply_aliases(spark, sf):
    entries = table(spark, sf, "part").selectExpr(
        "'option' as subject_type",
        "p_partkey as ord",
        "element_at(array('view', 'click', 'signup', 'purchase'), cast(p_partkey % 4 + 1 as int)) as slug",
        "p_name as name",
        "array('Phrase 1', p_type) as aliases",
    )
    promotable = _votes(spark, sf).where("status = 'promotable'")
    out = facts.apply_aliases(entries, promotable)
    return out.selectExpr("slug", "ord", "cast(size(aliases) as bigint) as n_aliases")


@query(
    "a10_mark_promoted",
    """SELECT event_id AS fact_id,
  CASE WHEN d.doc_id IS NOT NULL THEN 'promoted' ELSE event_type END AS source
FROM events LEFT JOIN (SELECT DISTINCT doc_id FROM labels) d ON event_id = doc_id""",
)
def a10_mark_promoted(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id as fact_id", "event_type as source")
    return facts.mark_promoted(rows, table(spark, sf, "labels").selectExpr("doc_id as fact_id"))


@query(
    "a27_findings_to_observations",
    """SELECT o_orderkey AS answer_id, 'district' AS subject_type, 'd' || o_custkey AS subject_id,
  'is_center' AS fact_type, '{"is_center":true}' AS fact_value, 'ai_inference' AS source FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT l_orderkey, 'complex', 'b' || l_suppkey, 'poi_' || c.cat,
  '{"present":' || (c.cat = 'school') || '}', 'ai_inference'
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), (VALUES ('school'), ('shop')) c(cat)""",
)
def a27_findings_to_observations(spark, sf):
    found = (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .distinct()
        .groupBy("l_orderkey")
        .agg(
            F.expr(
                "map_from_entries(collect_list(struct(concat('b', l_suppkey),"
                " map('school', true, 'shop', false))))"
            ).alias("poi_findings")
        )
    )
    answers = (
        table(spark, sf, "orders")
        .join(found, F.col("o_orderkey") == F.col("l_orderkey"), "full")
        .selectExpr(
            "coalesce(o_orderkey, l_orderkey) as answer_id",
            "case when o_orderstatus = 'F' then array(concat('d', o_custkey)) else array() end as center_district_ids",
            "poi_findings",
            "0.5D as confidence",
        )
    )
    return facts.findings_to_observations(answers).drop("confidence")


# --- call log -------------------------------------------------------------------------------


def call_log(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "ts as occurred_at",
        f"{K} % 3 <> 0 as had_poi_or_center",
        f"{K} % 5 < 2 as fully_resolved_deterministically",
        f"{K} % 7 = 1 as cache_hit",
        f"{K} % 4 = 0 as ai_called",
        f"({K} % 8 = 0 or {K} % 6 = 1) as criteria_changed_by_ai",
        "event_type = 'error' as ai_failed",
    )


SQL_LOG = f"""log AS (
  SELECT event_id, ts AS occurred_at, {SQL_K} % 3 <> 0 AS had_poi_or_center,
    {SQL_K} % 5 < 2 AS fully_resolved_deterministically, {SQL_K} % 7 = 1 AS cache_hit,
    {SQL_K} % 4 = 0 AS ai_called, ({SQL_K} % 8 = 0 OR {SQL_K} % 6 = 1) AS criteria_changed_by_ai,
    event_type = 'error' AS ai_failed FROM events)"""

SQL_COUNTS = ", ".join(f"count_if({cond}) AS {name}" for name, cond in usage.COUNTS.items())
SQL_SHARES = ", ".join(
    f"CASE WHEN {whole} > 0 THEN round_even(100.0 * {part} / {whole}, 1) ELSE 0.0 END::DOUBLE AS {name}"
    for name, (part, whole) in usage.SHARES.items()
)


@query(
    "a11_usage_report",
    with_sql(SQL_LOG, f"counted AS (SELECT {SQL_COUNTS} FROM log)") + f"SELECT *, {SQL_SHARES} FROM counted",
)
def a11_usage_report(spark, sf):
    return usage.usage_report(call_log(spark, sf))


@query(
    "a12_gate_readiness",
    with_sql(
        SQL_LOG,
        f"counted AS (SELECT {SQL_COUNTS} FROM (SELECT * FROM log ORDER BY occurred_at DESC, event_id DESC LIMIT 500))",
        f"shares AS (SELECT *, {SQL_SHARES} FROM counted)",
    )
    + """SELECT total, pct_fully_resolved_within_had, pct_changed_without_poi_or_center,
 total >= 500 AND pct_fully_resolved_within_had >= 90 AS resolved_gate_ready,
 total >= 500 AND pct_changed_without_poi_or_center <= 5 AS need_gate_ready FROM shares""",
)
def a12_gate_readiness(spark, sf):
    return usage.gate_readiness(call_log(spark, sf), 500)


@query(
    "a26_failure_streaks",
    with_sql(SQL_LOG)
    + f""", numbered AS (SELECT *, sum(CASE WHEN ai_failed THEN 0 ELSE 1 END)
     OVER (ORDER BY occurred_at, event_id) AS run FROM log),
grouped AS (SELECT count(*) AS failures, min(occurred_at) AS started_at, max(occurred_at) AS last_failure_at,
     max(occurred_at) + INTERVAL 60 SECOND AS open_until FROM numbered WHERE ai_failed GROUP BY run)
SELECT failures, {SQL_STAMP.format('started_at')}, {SQL_STAMP.format('last_failure_at')},
 {SQL_STAMP.format('open_until')} FROM grouped WHERE failures >= 2""",
)
def a26_failure_streaks(spark, sf):
    return _stamped(
        usage.failure_streaks(call_log(spark, sf)), "started_at", "last_failure_at", "open_until"
    )


@query(
    "s9_read_call_log",
    with_sql(SQL_LOG)
    + """SELECT event_id, had_poi_or_center, ai_failed FROM log
WHERE occurred_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY""",
)
def s9_read_call_log(spark, sf):
    path = scratch_path(spark, "call-log")
    rows = call_log(spark, sf).withColumn("occurred_at", F.expr("cast(occurred_at as timestamp)"))
    write_call_log(rows, path)
    log = read_call_log(spark, path, "2024-01-30 12:00:00", 7)
    return log.select("event_id", "had_poi_or_center", "ai_failed")


@query(
    "s9_last_days",
    with_sql(SQL_LOG)
    + "SELECT event_id FROM log WHERE occurred_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 3 DAY",
)
def s9_last_days(spark, sf):
    return last_days(call_log(spark, sf), "2024-01-30 12:00:00", 3).select("event_id")


# Step outcomes of P20: flags derived from order and customer keys.
STEP_FLAGS = {
    "center_requested": "o_orderkey % 5 = 0",
    "option_called": "o_orderkey % 7 = 0",
    "option_changed": "o_orderkey % 14 = 0",
    "option_failed": "o_custkey % 11 = 0",
    "text_called": "o_custkey % 3 = 0",
    "text_changed": "o_custkey % 9 = 0",
    "text_failed": "o_custkey % 13 = 0",
    "resolved": "o_orderkey % 2 = 0",
    "cache_hit": "o_custkey % 17 = 0",
    "model_called": "o_custkey % 17 <> 0 and o_orderkey % 3 = 0",
    "differs": "o_orderkey % 4 = 0",
}


@query(
    "p20_call_log_row",
    "WITH s AS (SELECT o_orderkey AS query_id, o_custkey % 4 AS n_poi, "
    + ", ".join(f"({v}) AS {k}" for k, v in STEP_FLAGS.items())
    + """ FROM orders)
SELECT query_id, n_poi > 0 OR center_requested AS had_poi_or_center, resolved AS fully_resolved_deterministically,
 cache_hit, text_called OR option_called OR model_called AS ai_called,
 option_changed OR text_changed OR ((cache_hit OR model_called) AND differs) AS criteria_changed_by_ai,
 text_failed OR option_failed AS ai_failed FROM s""",
)
def p20_call_log_row(spark, sf):
    outcomes = table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id", "o_custkey % 4 as n_poi", *[f"({v}) as {k}" for k, v in STEP_FLAGS.items()]
    )
    return usage.call_log_row(outcomes)
