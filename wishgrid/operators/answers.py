"""Model answers against what was offered, and merges into criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wishgrid.functions.text import normalize_key
from wishgrid.operators.audit import breaches
from wishgrid.operators.skew import bits, join_packed
from wishgrid.session import through_table

MAX_PLACE_M = 2000  # fixed value: largest distance a place requirement may carry


def shortlist_semi(answers: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Answered ``(query_id, kind, value)`` that were offered.

    ``kind`` is ``complex``, ``finding`` (both compared with offered ids) or ``district``, which is
    compared with the district *names* of the candidates.
    ``shortlist(query_id, place_id, district)``.
    """
    offered = shortlist.selectExpr(
        "query_id",
        "stack(3, 'complex', place_id, 'finding', place_id, 'district', district) as (kind, value)",
    ).where("value is not null")
    return answers.join(offered.distinct(), ["query_id", "kind", "value"], "left_semi")


def known_slugs_semi(answers: DataFrame, groups: DataFrame, options: DataFrame) -> DataFrame:
    """Answers with a known slug, told apart as group (preferred) or option, once per phrase key.

    ``answers(query_id, pos, phrase, slug, confidence)``, ``groups(slug)``, ``options(slug)``.
    """
    known = (
        groups.select("slug", F.lit("option_group").alias("subject_type"))
        .unionByName(options.select("slug", F.lit("option").alias("subject_type")))
        .where("coalesce(slug, '') <> ''")
        .groupBy("slug")
        .agg(F.max("subject_type").alias("subject_type"))
    )
    return (
        answers.join(known, "slug")
        .groupBy("query_id", normalize_key("phrase").alias("phrase_key"), "slug", "subject_type")
        .agg(F.min_by(F.struct("phrase", "confidence"), F.col("pos")).alias("a"))
        .select("query_id", "phrase_key", "slug", "subject_type", "a.*")
    )


def resolve_landmarks(answers: DataFrame, landmarks: DataFrame, residuals: DataFrame) -> DataFrame:
    """Known located slug and a phrase that was left over; one per landmark, the first.

    ``answers(query_id, pos, phrase, slug)``, ``residuals(query_id, phrase)``. A slug used twice in
    the catalogue means its last entry.
    """
    last = landmarks.where("coalesce(slug, '') <> ''").groupBy("slug").agg(
        F.max_by(F.struct("name", "lat", "lon", "category"), F.col("ord")).alias("l")
    )
    return (
        answers.join(residuals.select("query_id", "phrase").distinct(), ["query_id", "phrase"], "left_semi")
        .join(last, "slug")
        .where("l.lat is not null and l.lon is not null")
        .groupBy("query_id", "l.name")
        .agg(F.min_by(F.struct("l.lat", "l.lon", "l.category", "phrase", "pos"), F.col("pos")).alias("r"))
        .select("query_id", "name", "r.*")
    )


def resolve_finish(answers: DataFrame, residuals: DataFrame) -> DataFrame:
    """Distinct finishes whose phrase was left over. ``answers(query_id, pos, phrase, finish)``."""
    return (
        answers.where("finish is not null")
        .join(residuals.select("query_id", "phrase").distinct(), ["query_id", "phrase"], "left_semi")
        .groupBy("query_id", "finish")
        .agg(F.min("pos").alias("pos"))
    )


def resolve_poi(answers: DataFrame, residuals: DataFrame) -> DataFrame:
    """First answer per category; ``other`` is dropped, distances outside (0, 2000] are not kept.

    ``answers(query_id, pos, phrase, category, max_distance_m, only_new)``.
    """
    return (
        answers.where("category is not null and category <> 'other'")
        .join(residuals.select("query_id", "phrase").distinct(), ["query_id", "phrase"], "left_semi")
        .groupBy("query_id", "category")
        .agg(F.min_by(F.struct("phrase", "max_distance_m", "only_new", "pos"), F.col("pos")).alias("r"))
        .select("query_id", "category", "r.*")
        .withColumn(
            "max_distance_m",
            F.expr(f"case when max_distance_m > 0 and max_distance_m <= {MAX_PLACE_M} then max_distance_m end"),
        )
    )


def combine_blocks(rows: DataFrame) -> DataFrame:
    """``rows(query_id, existing array, fallback array)`` -> ``combined`` and a note.

    Nothing existing: the fallback. Otherwise the intersection, and where that is empty the
    existing list with a note.
    """
    return rows.withColumn("_both", F.array_intersect("existing", "fallback")).withColumn(
        "combined",
        F.expr(
            "case when size(existing) = 0 then array_distinct(fallback) when size(_both) = 0 then array_distinct(existing) else _both end"
        ),
    ).withColumn("note", F.expr("case when size(existing) > 0 and size(_both) = 0 then 'no_intersection' end")).drop("_both")


def fallback_blocks(
    steps: DataFrame, sides: DataFrame, ring: DataFrame, wanted: DataFrame | None = None, tags: DataFrame | None = None
) -> DataFrame:
    """Blocks of untrusted locations in first-seen order, cut to the requested side of the ring.

    ``steps(query_id, step, place_id, ord)``: places per untrusted location in order (station tag or
    radius-or-nearest, county tag, district tag); ``sides(query_id, within)``; ``ring(place_id, ord,
    inside)``. Without any block the side of the ring alone gives them, which is held per side, not
    per query. Result ``(query_id, place_id, seq)`` with NULL ``seq`` for side-only blocks.

    ``wanted(query_id, step, field, name)`` and ``tags(field, name, place_id, ord)`` tell further steps, after those listed in
    ``steps``, whose places are as many as queries times places of a tag: each is kept or left where they meet, and not shuffled.
    """
    first = through_table(steps.groupBy("query_id", "place_id").agg(F.min(F.struct("step", "ord")).alias("seq")), "steps")
    ring = through_table(ring.select("place_id", "inside"), "ring")
    asked = sides.where("within is not null")
    kept = (
        first.join(asked, "query_id", "left")
        .join(ring.select("place_id", "inside"), "place_id", "left")
        .where("within is null or within = inside")
        .select("query_id", "place_id", "seq")
    )
    served = first.select("query_id")
    if wanted is not None:
        wanted, tags = wanted.distinct(), tags.groupBy("field", "name", "place_id").agg(F.min("ord").alias("ord"))
        kept = kept.unionByName(_tagged_blocks(first, asked, ring, wanted, tags, kept.schema["seq"].dataType))
        served = served.unionByName(wanted.join(tags.select("field", "name").distinct(), ["field", "name"], "left_semi").select("query_id"))
    bare = asked.join(served.distinct(), "query_id", "left_anti")
    alone = join_packed(bare, ring.select("place_id", F.col("inside").alias("within")), ["within"]).select(
        "query_id", "place_id", F.lit(None).cast(kept.schema["seq"].dataType).alias("seq")
    )
    return kept.unionByName(alone)


def _tagged_blocks(listed: DataFrame, asked: DataFrame, ring: DataFrame, wanted: DataFrame, tags: DataFrame, seq: StructType) -> DataFrame:
    """Places of the wanted tags that neither a listed step nor an earlier tag of the query gives."""
    tag = F.to_json(F.struct("field", "name"))
    order = F.struct("step", "field", "name")
    wants = wanted.groupBy("query_id").agg(F.collect_list(F.struct(order.alias("o"), tag.alias("tag"))).alias("wants"))
    near = listed.groupBy("query_id").agg(F.collect_list("place_id").alias("near"))
    sides = F.expr("case when within is null then array('in', 'out', 'none') when within then array('in') else array('out') end")
    queries = (
        wanted.join(wants, "query_id")
        .withColumn("earlier", F.transform(F.filter("wants", lambda w: w["o"] < order), lambda w: w["tag"]))
        .drop("wants")
        .join(near, "query_id", "left")
        .join(asked, "query_id", "left")
        .withColumn("side", F.explode(sides))
        .drop("within")
        .withColumns({"earlier_bits": bits("earlier"), "near_bits": bits("near")})
    )
    carried = tags.groupBy("place_id").agg(F.collect_set(tag).alias("carried"))
    held = (
        tags.join(carried, "place_id")
        .join(ring.select("place_id", "inside"), "place_id", "left")
        .withColumn("side", F.expr("case when inside is null then 'none' when inside then 'in' else 'out' end"))
        .drop("inside")
        .withColumns({"carried_bits": bits("carried"), "place_bits": bits(F.array("place_id"))})
    )
    return (
        join_packed(queries, held, ["field", "name", "side"])
        .where("earlier_bits & carried_bits = 0 or not arrays_overlap(earlier, carried)")
        .where("near is null or near_bits & place_bits = 0 or not array_contains(near, place_id)")
        .select("query_id", "place_id", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in seq]).alias("seq"))
    )


def merge_enrichment(criteria: DataFrame, results: DataFrame, complexes: DataFrame, districts: DataFrame) -> DataFrame:
    """Matched complexes replace the requested ones, centre districts are appended.

    ``criteria(query_id, complexes array, districts array)`` of ids; ``results(query_id, matched,
    matched_ids array, district_ids array)``. Only ids of the catalogue count. ``matched_empty``
    marks a narrowing that left nothing.
    """
    def known(df: DataFrame, column: str, catalog: DataFrame, distinct: bool) -> DataFrame:
        rows = df.select("query_id", F.posexplode(column).alias("pos", "id"))
        if distinct:
            rows = rows.groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
        valid = rows.join(catalog.select("id").distinct(), "id", "left_semi")
        return valid.groupBy("query_id").agg(
            F.expr("transform(array_sort(collect_list(struct(pos, id))), x -> x.id)").alias("_" + column)
        )

    none = F.expr("cast(array() as array<string>)")
    return (
        criteria.join(results.select("query_id", "matched"), "query_id", "left")
        .join(known(results, "matched_ids", complexes, True), "query_id", "left")
        .join(known(results, "district_ids", districts, False), "query_id", "left")
        .withColumn("complexes", F.when(F.col("matched"), F.coalesce("_matched_ids", none)).otherwise(F.col("complexes")))
        .withColumn("districts", F.concat("districts", F.coalesce("_district_ids", none)))
        .withColumn("matched_empty", F.expr("coalesce(matched, false) and size(complexes) = 0"))
        .select("query_id", "complexes", "districts", "matched_empty")
    )


def fill_missing(criteria: DataFrame, answers: DataFrame, scalars: list[str], lists: list[str], flags: list[str]) -> DataFrame:
    """U4: answers fill what rules left open: NULL scalars, empty lists, false flags.

    A value out of range is refused: the field stays open and is named in ``rejected``.
    """
    renamed = answers.select("query_id", *[F.col(c).alias(f"a_{c}") for c in [*scalars, *lists, *flags]])
    checked = answers.select("query_id", *scalars)
    bad = checked.select("query_id", F.expr(breaches(scalars)).alias("bad"))
    joined = criteria.join(renamed, "query_id", "left").join(bad, "query_id", "left")
    offered = [f"case when {c} is null and a_{c} is not null and array_contains(bad, '{c}') then '{c}' end" for c in scalars]
    out = {c: f"case when {c} is null and not coalesce(array_contains(bad, '{c}'), false) then a_{c} else {c} end" for c in scalars}
    out |= {c: f"case when size({c}) = 0 then coalesce(array_distinct(a_{c}), {c}) else {c} end" for c in lists}
    out |= {c: f"{c} or coalesce(a_{c}, false)" for c in flags}
    changed = [f"({c} is null and a_{c} is not null and not coalesce(array_contains(bad, '{c}'), false))" for c in scalars]
    changed += [f"(size({c}) = 0 and coalesce(size(a_{c}), 0) > 0)" for c in lists]
    changed += [f"(not {c} and coalesce(a_{c}, false))" for c in flags]
    return joined.selectExpr(
        "query_id", *[f"{e} as {c}" for c, e in out.items()],
        f"array_compact(array({', '.join(offered)})) as rejected", f"({' or '.join(changed)}) as changed",
    )


def differs(rows: DataFrame) -> DataFrame:
    """Set inequality of complex and district ids: ``(result_ids, known_ids, result_districts, known_districts)``."""
    return rows.withColumn(
        "differs",
        F.expr(
            "size(array_except(result_ids, known_ids)) + size(array_except(known_ids, result_ids))"
            " + size(array_except(result_districts, known_districts)) + size(array_except(known_districts, result_districts)) > 0"
        ),
    )


def query_signature(text: str = "text") -> str:
    """P13 on ``text, poi array<struct<category, only_new, max_distance_m>>, center_requested,
    landmarks array<string>, classes array<string>``."""
    key = "trim(regexp_replace(translate(replace(lower(x), 'ß', 'ss'), 'ёabcehkmoptxy', 'еавсенкмортху'), r'(?U)\\s+', ' '))"
    poi = (
        "array_join(array_sort(transform(poi, p -> concat_ws(':', p.category, case when p.only_new then 'new' end,"
        " concat('d', p.max_distance_m)))), ',')"
    )
    return (
        f"concat_ws(' | ', trim(lower({text})), case when size(poi) > 0 then concat('poi=', {poi}) end,"
        " case when center_requested then 'center=1' end,"
        f" case when size(landmarks) > 0 then concat('landmark=', array_join(array_sort(transform(landmarks, x -> {key})), ',')) end,"
        f" case when size(classes) > 0 then concat('station_class=', array_join(array_sort(transform(classes, x -> {key})), ',')) end)"
    )
