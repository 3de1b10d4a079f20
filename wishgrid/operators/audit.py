"""Corpus and result audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wishgrid.functions.spans import lit
from wishgrid.functions.text import normalize_key
from wishgrid.packs import russian as ru
from wishgrid.packs.params import LINK_BASE

# Least and greatest allowed value per criteria field.
RANGES = {
    "price_min": (0, None), "price_max": (0, None), "area_min": (0, None), "area_max": (0, None),
    "area_kitchen_min": (0, None), "area_kitchen_max": (0, None), "floor_min": (1, None), "floor_max": (1, None),
    "time_on_foot": (1, None), "time_on_transport": (1, None), "settlement_year_from": (2000, None),
    "settlement_year_to": (2000, None), "settlement_month_from": (1, 12), "settlement_month_to": (1, 12),
}
NEAR_EMPTY_WORDS = 3
ORPHAN_LENGTH = 2
TOP_PHRASES = 30
EXAMPLES = 5
UNRECOGNISED = "»: не удалось распознать, не попало в ссылку"


def breaches(columns: list[str]) -> str:
    """V1: names of the fields whose value is out of range, as an array expression."""
    tests = []
    for field, (low, high) in RANGES.items():
        if field in columns:
            cond = f"{field} < {low}" + (f" or {field} > {high}" if high is not None else "")
            tests.append(f"case when {cond} then '{field}' end")
    return f"array_compact(array({', '.join(tests)}))" if tests else "cast(array() as array<string>)"


def check_criteria(criteria: DataFrame) -> DataFrame:
    """V1: one row ``(query_id, field)`` per breach."""
    return criteria.selectExpr("query_id", f"explode({breaches(criteria.columns)}) as field")


def dedupe_requirements(requirements: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Least distance per (key, category, new); NULL only where no distance is stated.

    The phrase is the first by ``order`` (equal ones: by the phrase), wherever the least distance stands.
    """
    return requirements.groupBy(*keys, "category", "only_new").agg(
        F.min("max_distance_m").alias("max_distance_m"), F.min(F.struct(order, "raw_phrase")).getField("raw_phrase").alias("raw_phrase")
    )


def coverage_ratio(text: str, phrases: str) -> str:
    """1 - characters not understood / all characters, at least 0; 1 for an empty text."""
    lost = f"aggregate({phrases}, 0L, (n, p) -> n + length(p))"
    return f"case when length({text}) = 0 then 1.0D else greatest(0.0D, 1.0D - {lost} / length({text})) end"


def significant_words(text: str) -> str:
    return f"size(regexp_extract_all(lower({text}), '[а-яёa-z0-9]+', 0))"


def corpus_report(parsed: DataFrame) -> DataFrame:
    """``parsed(query_id, text, n_fields, phrases, link, crashed)`` -> one row of totals."""
    rows = parsed.selectExpr(
        "crashed", "n_fields", f"{significant_words('text')} as words", f"link = '{LINK_BASE}' as bare",
        f"{coverage_ratio('text', 'phrases')} as coverage",
    )
    return rows.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.expr("count_if(crashed)").alias("crashes"),
        F.expr("count_if(not crashed and n_fields = 0 and words > 0)").alias("empty_criteria"),
        F.expr(f"count_if(not crashed and n_fields <= 1 and words > {NEAR_EMPTY_WORDS})").alias("near_empty_criteria"),
        F.expr("count_if(not crashed and bare)").alias("no_filter_links"),
        F.expr("coalesce(avg(coverage) filter (where not crashed), 0.0D)").alias("avg_coverage"),
    )


def complex_report(results: DataFrame) -> DataFrame:
    """``results(query_id, text, n_fields, phrases, link, crashed, n_blocks)``."""
    base = corpus_report(results).select("total_queries", "crashes", "no_filter_links", "avg_coverage").withColumn("one", F.lit(1))
    more = results.agg(
        F.expr("count_if(not crashed and n_blocks = 0)").alias("without_blocks"),
        F.expr("coalesce(avg(n_fields) filter (where not crashed), 0.0D)").alias("avg_filter_count"),
    ).withColumn("one", F.lit(1))
    return base.join(more, "one").drop("one")


def warning_classes(warnings: DataFrame) -> DataFrame:
    """``warnings(query_id, text, warning)`` -> per template its count and first five texts.

    Quoted parts become a placeholder. The examples of a frequent template are picked by a bounded
    ranking, never by gathering all its texts.
    """
    rows = warnings.withColumn("template", F.trim(F.regexp_replace("warning", "«[^»]*»", "«…»")))
    counts = rows.groupBy("template").agg(F.count(F.lit(1)).alias("count"))
    first = rows.groupBy("template", "text").agg(F.min("query_id").alias("query_id"))
    order = Window.partitionBy("template").orderBy("query_id", "text")
    examples = (
        first.withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= EXAMPLES)
        .groupBy("template")
        .agg(F.expr("transform(array_sort(collect_list(struct(r, text))), x -> x.text)").alias("examples"))
    )
    return counts.join(examples, "template")


def clean_phrase(c: str) -> str:
    return f"lower(trim(both ' ,.-:;!?()' from {c}))"


def phrase_counts(phrases: DataFrame) -> DataFrame:
    """``phrases(phrase)`` -> cleaned phrase and count."""
    cleaned = phrases.selectExpr(f"{clean_phrase('phrase')} as phrase").where("phrase <> ''")
    return cleaned.groupBy("phrase").agg(F.count(F.lit(1)).alias("count"))


def top_residuals(phrases: DataFrame, limit: int = TOP_PHRASES) -> DataFrame:
    """The most frequent phrases; ties in alphabetical order."""
    return phrase_counts(phrases).orderBy(F.desc("count"), "phrase").limit(limit)


def orphans(phrases: DataFrame) -> DataFrame:
    """Phrases of at most two characters."""
    return phrase_counts(phrases).where(F.length("phrase") <= ORPHAN_LENGTH)


def open_fragments(warnings: DataFrame, greetings: DataFrame) -> DataFrame:
    """``(query_id, seq, fragment)`` recovered from warnings, without mere greetings.

    ``warnings(query_id, seq, warning)``, ``greetings(greeting)``.
    """
    cut = len(UNRECOGNISED)
    rows = warnings.where(
        F.col("warning").startswith("«") & F.col("warning").endswith(UNRECOGNISED)
    ).selectExpr("query_id", "seq", f"substring(warning, 2, length(warning) - {cut} - 1) as fragment")
    keyed = rows.withColumn("key", normalize_key(F.expr("trim(both ' ,.!?…:;-–—()' from fragment)")))
    known = greetings.select(normalize_key("greeting").alias("key")).distinct()
    return keyed.join(known, "key", "left_anti").drop("key")


def describe_unmet(criteria: DataFrame) -> DataFrame:
    """``unmet array<struct<phrase, only_new, max_distance_m>>`` of places and the centre."""
    return criteria.withColumn(
        "unmet",
        F.expr(
            "concat(transform(poi_requirements, r -> named_struct('phrase', r.raw_phrase, 'only_new', r.only_new,"
            " 'max_distance_m', r.max_distance_m)), case when center_requested then array(named_struct('phrase', 'в центре',"
            " 'only_new', false, 'max_distance_m', cast(null as int))) else filter(transform(poi_requirements, r ->"
            " named_struct('phrase', r.raw_phrase, 'only_new', r.only_new, 'max_distance_m', r.max_distance_m)), z -> false) end)"
        ),
    )


def marker_tags(text: Column, markers: list[str]) -> Column:
    """The markers that occur in the lower-cased text, in list order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in markers]))


def derive_names(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Per group the most common county of its members; ties go to the one met first.

    ``groups(group_id, pos, member_id)``, ``members(member_id, county)``.
    """
    known = groups.join(members, "member_id", "left")
    votes = known.where("coalesce(county, '') <> ''").groupBy("group_id", "county").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")
    )
    best = votes.groupBy("group_id").agg(
        F.expr("max_by(county, struct(n, -first_pos))").alias("best_name"),
        F.count(F.lit(1)).alias("names"),
        F.sum("n").alias("named"),
    )
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    return sizes.join(best, "group_id", "left").na.fill(0, ["names", "named"])


def new_candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """Not known yet (ignoring case), credited to the first query that found them, by stars.

    ``found(query_pos, item_pos, full_name, stars)``, ``known(full_name)``.
    """
    keyed = found.withColumn("key", F.lower("full_name"))
    fresh = keyed.join(known.select(F.lower("full_name").alias("key")).distinct(), "key", "left_anti")
    first = fresh.groupBy("key").agg(
        F.min_by(F.struct("full_name", "stars", "query_pos"), F.struct("query_pos", "item_pos")).alias("f")
    )
    return first.select("f.*").orderBy(F.desc(F.coalesce("stars", F.lit(0))), "query_pos", "full_name")


def curated_facts(curated: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curated rows with fetched metadata, sorted by category and stars; and the missing ones."""
    left = curated.withColumn("key", F.lower("full_name"))
    right = metadata.withColumn("key", F.lower("full_name")).drop("full_name")
    present = left.join(right, "key").drop("key").orderBy("category", F.desc(F.coalesce("stars", F.lit(0))), "full_name")
    return present, left.join(right, "key", "left_anti").drop("key")


def chunk_word_count(c: str) -> str:
    return f"size(regexp_extract_all({c}, {lit(ru.CHUNK_WORD)}, 0))"
