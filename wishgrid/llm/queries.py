"""One query per operator over the shared tables, and SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wishgrid.llm.common import joined_names
from wishgrid.llm.conversations import repaired_conversations
from wishgrid.llm.decontaminate import contaminated, contamination
from wishgrid.llm.html_text import extract_text
from wishgrid.llm.langid import fit, held_out, identify
from wishgrid.llm.line_dedup import repeated_units
from wishgrid.llm.mixing import mix_sources
from wishgrid.llm.neighbours import nearest_neighbours
from wishgrid.llm.order_minhash import near_duplicates
from wishgrid.llm.spelling import spelling_variants
from wishgrid.llm.substring_dedup import remove_repeats
from wishgrid.llm.token_files import round_trip
from wishgrid.llm.toxicity import fit as fit_toxicity
from wishgrid.llm.toxicity import held_out as toxicity_held_out
from wishgrid.llm.toxicity import toxicity
from wishgrid.llm.url_filter import judge_urls

#: Fixed values of the URL rules.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return judge_urls(_table(spark, sf, "pages"), rules)


def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.expr(joined_names("items")), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(_table(spark, sf, "documents"))


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = repeated_units(_table(spark, sf, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"].cast("string"), s["len"].cast("string"))), ",")
    return found.select("doc_id", "n_units", "n_removed", "chars_removed", spans.alias("spans"))


def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    told = identify(docs.select("doc_id", "text"), fit(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(_table(spark, sf, "pages"))


def op8_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents")).select("doc_id", "class_id")


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(_table(spark, sf, "documents"))


def op10_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf, "embeddings"))


def op11_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return repaired_conversations(_table(spark, sf, "conversations"))


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(_table(spark, sf, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    scored = toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, _table(spark, sf, "labels")))
    held = toxicity_held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_html_text": op7_html_text,
    "op8_order_minhash": op8_order_minhash,
    "op9_token_files": op9_token_files,
    "op10_neighbours": op10_neighbours,
    "op11_conversations": op11_conversations,
    "op12_spelling": op12_spelling,
    "op13_toxicity": op13_toxicity,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULE_ROWS = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)

OP1_SQL = f"""
WITH u AS (
  SELECT page_id,
         coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS p
  FROM (VALUES {_RULE_ROWS}) AS t(rule, verdict)),
k AS (SELECT DISTINCT host, path FROM u),
best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM k JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (host, path)
"""

_HASH32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"

OP2_SQL = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         {_HASH32.format("coalesce(doc_id::VARCHAR, '')")} AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
placed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes),
filled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(source_size) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
            / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM placed),
targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(
           (SELECT min_by(f.level, f.source_size * 2.0::DOUBLE / f.weight) FROM filled f
            WHERE f.level * f.weight < f.source_size * 2.0::DOUBLE) * weight, source_size * 2.0::DOUBLE)) AS target,
         {_HASH32.format("'mix' || coalesce(source, chr(0))")} / 4294967296.0::DOUBLE AS u
  FROM filled),
ranked AS (
  SELECT doc_id, size, t.source_size, t.target, u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY b.source ORDER BY size, h % parts, h, doc_id) AS rank
  FROM (SELECT *, (count(*) OVER (PARTITION BY source, size) + 4095) // 4096 AS parts FROM base) b
  JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rank * rate + u) - floor((rank - 1) * rate + u)) * size)::BIGINT AS taken
FROM ranked
"""

_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3_SQL = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM grams),
dg AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT r, i, dg.n, item FROM dg JOIN grams ON dg.n = grams.n AND dg.gram = grams.gram),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS u FROM documents),
units AS (
  SELECT r, doc_id, i - 1 AS pos, u[i] AS unit, trim(regexp_replace(lower(u[i]), '[\\x09-\\x0D\\x85\\p{Z}]+', ' ', 'g')) AS norm
  FROM (SELECT r, doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM d)),
marked AS (
  SELECT *, sum(length(unit) + 1) OVER (PARTITION BY r ORDER BY pos) - length(unit) - 1 AS start,
         norm <> '' AS enough,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS FIRST, pos) AS k
  FROM units),
sums AS (
  SELECT r, count(*) AS n_units, count(*) FILTER (enough AND k > 1) AS n_removed,
         sum(length(unit)) FILTER (enough AND k > 1) AS chars_removed,
         string_agg(start::BIGINT || '+' || length(unit), ',' ORDER BY pos) FILTER (enough AND k > 1) AS spans
  FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(chars_removed, 0)::BIGINT AS chars_removed, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (r)
"""

ORACLES = {"op5_line_dedup": OP5_SQL, "op1_url_filter": OP1_SQL, "op2_mix_sources": OP2_SQL, "op3_decontaminate": OP3_SQL}
