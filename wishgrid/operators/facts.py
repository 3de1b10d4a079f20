"""Fact observations: folding, promotion, alias votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wishgrid.functions.text import normalize_key

FACT_KEY = ["subject_type", "subject_id", "fact_type"]

# Promotion thresholds and the version from which a place record separates
# operating objects from building sites.
MIN_OBSERVATIONS = 5
MIN_CONFIDENCE = 0.8
MIN_CONSISTENCY = 1.0
POI_SCHEMA_VERSION = 2
PROMOTED = "promoted"
ALIAS_FACT = "option_alias"


def canonical_json(c: Column | str) -> Column:
    """One spelling per JSON value: keys sorted, no insignificant white space. Text that is no JSON stays."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def slice_facts(observations: DataFrame, keys: list[str] | None = None, chunk_seconds: int = 86400) -> DataFrame:
    """One row per fact and slice of time (``chunk``): what its ordered observations add to the fold.

    A slice holds its number of rows and value changes, first and last time, its first value and, as
    ``tail``, the latest observation and the greatest confidence of the trailing run of equal values.
    """
    keys = keys or FACT_KEY
    chunk = [*keys, "chunk"]
    in_chunk = Window.partitionBy(*chunk).orderBy("observed_at", "event_order")
    rows = with_chunk(observations, chunk_seconds).withColumn("_value", canonical_json("fact_value"))
    previous = F.lag("_value").over(in_chunk)
    marked = rows.withColumn(
        "changed",
        F.when(previous.isNull(), 0).when(previous == F.col("_value"), 0).otherwise(1),
    ).withColumn("run", F.sum("changed").over(in_chunk))
    runs = marked.groupBy(*chunk, "run").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("confidence").alias("run_confidence"),
        F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_confirmed_at"),
        F.expr("max_by(struct(fact_value, source, _value), struct(observed_at, event_order))").alias("latest"),
        F.first("_value").alias("run_value"),
    )
    return runs.groupBy(*chunk).agg(
        F.sum("n").alias("n"),
        F.max("run").alias("changes"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_confirmed_at").alias("last_confirmed_at"),
        F.expr("min_by(run_value, run)").alias("first_value"),
        F.expr("max_by(struct(latest, run_confidence), run)").alias("tail"),
    )


def with_chunk(observations: DataFrame, chunk_seconds: int) -> DataFrame:
    """Adds ``chunk``, the number of the slice of time that holds the observation."""
    seconds = f"unix_seconds(cast(observed_at as timestamp)) / {chunk_seconds}"
    return observations.withColumn("chunk", F.expr(f"cast(floor({seconds}) as bigint)"))


def join_slices(slices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All slices of a fact as a single one, under its latest ``chunk``.

    The result has the columns of ``slice_facts`` and can meet later slices again: joining is
    associative, so a fact can be folded piece by piece.
    """
    keys = keys or FACT_KEY
    over_key = Window.partitionBy(*keys).orderBy("chunk")
    before = F.lag("tail.latest._value").over(over_key)
    stitched = (
        slices.withColumn(
            "seam", F.when(before.isNull() | (before == F.col("first_value")), 0).otherwise(1)
        )
        .withColumn("broken", F.expr("seam + changes > 0"))
        .withColumn("segment", F.sum(F.col("broken").cast("int")).over(over_key))
    )
    segments = stitched.groupBy(*keys, "segment").agg(
        F.max("chunk").alias("chunk"),
        F.sum("n").alias("n"),
        F.expr("sum(changes + seam)").alias("changes"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_confirmed_at").alias("last_confirmed_at"),
        F.expr("min_by(first_value, chunk)").alias("first_value"),
        F.expr("max_by(tail.latest, chunk)").alias("latest"),
        F.max("tail.run_confidence").alias("run_confidence"),
    )
    return segments.groupBy(*keys).agg(
        F.max("chunk").alias("chunk"),
        F.sum("n").alias("n"),
        F.sum("changes").alias("changes"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_confirmed_at").alias("last_confirmed_at"),
        F.expr("min_by(first_value, segment)").alias("first_value"),
        F.expr("max_by(struct(latest, run_confidence), segment)").alias("tail"),
    )


def folded_slices(slices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The folded facts (A4) of a table of slices."""
    return join_slices(slices, keys).select(
        *(keys or FACT_KEY),
        F.col("tail.latest.fact_value").alias("fact_value"),
        F.col("tail.latest.source").alias("source"),
        F.col("tail.run_confidence").alias("confidence"),
        F.col("n").alias("observed_count"),
        F.col("changes").alias("conflicts"),
        "first_seen_at",
        "last_confirmed_at",
    )


def fold_facts(
    observations: DataFrame, keys: list[str] | None = None, chunk_seconds: int = 86400
) -> DataFrame:
    """A4: one row per fact from ordered observations; values are compared as JSON, not as text.

    ``observations(subject_type, subject_id, fact_type, fact_value, source, confidence,
    observed_at, event_order)``. Kept: latest value and source, number of observations, first and
    last time, number of value changes, and the greatest confidence of the trailing run of equal
    values.

    A fact seen by a third of all rows is not sorted in one task: every key is cut into slices of
    time, each slice is folded by itself, and only slice summaries meet per key.
    """
    return folded_slices(slice_facts(observations, keys, chunk_seconds), keys)


def promotable_facts(
    facts: DataFrame, n: int = MIN_OBSERVATIONS, c: float = MIN_CONFIDENCE
) -> DataFrame:
    """A5: seen often enough, trusted enough and not promoted yet."""
    return facts.where(
        (F.col("observed_count") >= n) & (F.col("confidence") >= c) & (F.col("source") != PROMOTED)
    )


def promote_centre(facts: DataFrame, areas: DataFrame) -> DataFrame:
    """Set ``is_center`` of matching areas; facts without an area are ignored.

    ``facts(subject_type, subject_id, fact_type, fact_value)`` with at most one row per key,
    ``areas(kind, id, …, is_center)``.
    """
    said = facts.where(
        (F.col("fact_type") == "is_center") & F.col("subject_type").isin("county", "district")
    ).select(
        F.col("subject_type").alias("kind"),
        F.col("subject_id").alias("id"),
        F.expr("cast(get_json_object(fact_value, '$.is_center') as boolean)").alias("said_center"),
        F.lit(True).alias("said"),
    )
    joined = areas.join(said, ["kind", "id"], "left")
    value = F.when(F.col("said"), F.col("said_center")).otherwise(F.col("is_center"))
    return joined.withColumn("is_center", value).select(*areas.columns)


def promote_poi(facts: DataFrame, complexes: DataFrame, poi: DataFrame) -> DataFrame:
    """Outcome per presence fact: ``inserted``, ``agreed``, ``rejected`` or ``ignored``.

    ``complexes(id, slug)``, ``poi(slug, category, count, count_operational, schema_version)``.
    """
    said = facts.where(
        (F.col("subject_type") == "complex") & F.col("fact_type").startswith("poi_")
    ).select(
        "subject_id",
        "fact_type",
        F.expr("substring(fact_type, 5)").alias("category"),
        F.expr("coalesce(cast(get_json_object(fact_value, '$.present') as boolean), false)").alias(
            "present"
        ),
    )
    known = poi.select(
        "slug",
        "category",
        F.expr(
            f"case when schema_version >= {POI_SCHEMA_VERSION} then count_operational > 0"
            " else count > 0 end"
        ).alias("measured"),
    )
    slugs = complexes.where("id is not null and slug is not null").select(
        F.col("id").alias("subject_id"), "slug"
    )
    outcome = F.expr(
        "case when slug is null then 'ignored' when measured is null then 'inserted'"
        " when measured = present then 'agreed' else 'rejected' end"
    )
    return (
        said.join(slugs, "subject_id", "left")
        .join(known, ["slug", "category"], "left")
        .select("subject_id", "fact_type", "slug", "category", "present", outcome.alias("outcome"))
    )


def poi_after_promotion(outcomes: DataFrame, poi: DataFrame) -> DataFrame:
    """The place table with the inserted presence records of ``promote_poi`` added."""
    number = F.col("present").cast("int")
    added = outcomes.where(F.col("outcome") == "inserted").select(
        "slug",
        "category",
        number.alias("count"),
        number.alias("count_operational"),
        F.lit(POI_SCHEMA_VERSION).alias("schema_version"),
    )
    return poi.unionByName(added.dropDuplicates(["slug", "category"]), allowMissingColumns=True)


def alias_votes(
    facts: DataFrame,
    n: int = MIN_OBSERVATIONS,
    c: float = MIN_CONFIDENCE,
    consistency: float = MIN_CONSISTENCY,
) -> DataFrame:
    """Per phrase the dominant slug and whether it is promotable, ambiguous or silent.

    ``facts(fact_id, subject_type, subject_id, phrase, observed_count, confidence)``; ties go to
    the slug seen first. Both levels combine on the map side.
    """
    votes = (
        facts.withColumn("phrase", normalize_key("phrase"))
        .where("phrase <> ''")
        .groupBy("phrase", "subject_id")
        .agg(
            F.sum("observed_count").alias("votes"),
            F.max("confidence").alias("confidence"),
            F.min("fact_id").alias("first_id"),
            F.max_by("subject_type", "fact_id").alias("subject_type"),
        )
    )
    per_phrase = votes.groupBy("phrase").agg(
        F.sum("votes").alias("total"),
        F.count(F.lit(1)).alias("slugs"),
        F.expr(
            "max_by(struct(subject_id, subject_type, votes, confidence), struct(votes, -first_id))"
        ).alias("top"),
    )
    status = F.expr(
        f"case when slugs > 1 and top.votes / total < {consistency} then 'ambiguous'"
        f" when top.votes >= {n} and top.confidence >= {c} then 'promotable' else 'silent' end"
    )
    return per_phrase.select(
        "phrase",
        F.col("top.subject_type").alias("subject_type"),
        F.col("top.subject_id").alias("slug"),
        F.col("top.votes").alias("votes"),
        F.col("top.confidence").alias("confidence"),
        "total",
        "slugs",
        status.alias("status"),
    )


def apply_aliases(entries: DataFrame, promotable: DataFrame) -> DataFrame:
    """Append promoted phrases to the first entry of the slug; known phrases change nothing.

    ``entries(subject_type, ord, slug, name, aliases)``, ``promotable(subject_type, slug, phrase)``.
    """
    first = entries.where("slug is not null").groupBy("subject_type", "slug").agg(
        F.min("ord").alias("ord")
    )
    phrases = (
        promotable.join(first, ["subject_type", "slug"])
        .groupBy("subject_type", "ord")
        .agg(F.sort_array(F.collect_set("phrase")).alias("phrases"))
    )
    known = F.concat(
        F.transform("aliases", normalize_key), F.array(normalize_key("name"))
    )
    fresh = F.array_except(F.coalesce("phrases", F.array().cast("array<string>")), known)
    return (
        entries.join(phrases, ["subject_type", "ord"], "left")
        .withColumn("aliases", F.concat("aliases", fresh))
        .select(*entries.columns)
    )


def mark_promoted(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """A10: ``source`` becomes ``promoted`` for the given ``fact_id``."""
    flagged = facts.join(
        ids.select("fact_id").distinct().withColumn("hit", F.lit(True)), "fact_id", "left"
    )
    return flagged.withColumn(
        "source", F.when(F.col("hit"), F.lit(PROMOTED)).otherwise(F.col("source"))
    ).select(*facts.columns)


def findings_to_observations(answers: DataFrame) -> DataFrame:
    """Answers -> observation rows.

    ``answers(answer_id, center_district_ids array<string>,
    poi_findings map<string, map<string, boolean>>, confidence)``.
    """
    centres = answers.select(
        "answer_id",
        F.lit("district").alias("subject_type"),
        F.explode("center_district_ids").alias("subject_id"),
        F.lit("is_center").alias("fact_type"),
        F.lit('{"is_center":true}').alias("fact_value"),
        "confidence",
    )
    found = (
        answers.select("answer_id", "confidence", F.explode("poi_findings").alias("subject_id", "m"))
        .select("answer_id", "confidence", "subject_id", F.explode("m").alias("category", "present"))
        .select(
            "answer_id",
            F.lit("complex").alias("subject_type"),
            "subject_id",
            F.concat(F.lit("poi_"), "category").alias("fact_type"),
            F.concat(F.lit('{"present":'), F.col("present").cast("string"), F.lit("}")).alias(
                "fact_value"
            ),
            "confidence",
        )
    )
    return centres.unionByName(found).withColumn("source", F.lit("ai_inference"))
