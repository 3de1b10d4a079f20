"""Reference data: look-ups, linkage, merges and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wishgrid.functions.text import normalize_key
from wishgrid.operators.similar import similar_pairs
from wishgrid.operators.skew import bits, join_packed
from wishgrid.session import through_table

# Fixed values.
CAPITAL = "Москва"
DIAMETER_NETWORK = "МЦД"
RING_REF = "14"
RING_LABEL = "МЦК"
STATION_RAILWAY = ("station", "halt", "stop", "stop_position", "tram_stop")
STATION_TRANSPORT = ("stop_position", "station", "platform")
LINE_SEPARATOR = " / "
FUZZY_THRESHOLD = 93.0
FUZZY_MIN_LENGTH = 6


def name_keys(entries: DataFrame) -> DataFrame:
    """``(key, ord, seq, is_name)``: matching keys of names and aliases."""
    keys = F.concat(F.array(normalize_key("name")), F.transform("aliases", normalize_key))
    return entries.select("ord", F.posexplode(keys).alias("seq", "key")).withColumn(
        "is_name", F.col("seq") == 0
    )


def find_by_name(entries: DataFrame, names: DataFrame) -> DataFrame:
    """``names(name)`` -> first entry in file order whose name or alias is equal.

    The first entry per key is found once by a map-side minimum, so a common name is cheap.
    """
    first = name_keys(entries).groupBy("key").agg(F.min("ord").alias("ord"))
    asked = names.select(F.col("name").alias("asked"), normalize_key("name").alias("key"))
    return asked.join(first, "key").join(entries, "ord")


def tag_table(complexes: DataFrame) -> DataFrame:
    """``(ord, field, tag_key)``: the non-empty location tags of every complex."""
    tags = complexes.selectExpr(
        "ord", "stack(3, 'district', district, 'county', county, 'metro', metro) as (field, tag)"
    )
    return tags.where("coalesce(tag, '') <> ''").select("ord", "field", normalize_key("tag").alias("tag_key"))


def by_tag(complexes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Complexes with an id whose tag ``field`` equals the name; ``wanted(field, name)``."""
    asked = wanted.select("field", "name", normalize_key("name").alias("tag_key")).distinct()
    tagged = tag_table(complexes.where("coalesce(place_id, '') <> ''"))
    return (
        asked.join(tagged, ["field", "tag_key"])
        .join(complexes.select("ord", "place_id"), "ord")
        .select("field", "name", "ord", "place_id")
    )


def location_filter(complexes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per query the complexes carrying any of the requested names in any tag.

    ``wanted(query_id, name)``. Names are shared by many queries, so matches are found per name. A complex that
    carries several names of a query is kept for the least of them, which the row itself tells: the matches, far more
    than either side, are not shuffled again. Only where bits say that a lesser name may be shared are names compared.
    """
    keyed = wanted.select("query_id", normalize_key("name").alias("tag_key")).where("tag_key is not null")
    keyed = keyed.groupBy("query_id").agg(F.collect_set("tag_key").alias("names"))
    tagged = tag_table(complexes).groupBy("ord").agg(F.collect_set("tag_key").alias("tags"))

    def by_name(df: DataFrame, key: str, names: str) -> DataFrame:
        each = df.select(key, F.explode(names).alias("tag_key"), names)
        lesser = each.select("tag_key", key, F.expr(f"filter({names}, x -> x < tag_key)").alias(names))
        return lesser.withColumn(f"{names}_bits", bits(names))

    pairs = join_packed(by_name(keyed, "query_id", "names"), by_name(tagged, "ord", "tags"), ["tag_key"])
    return pairs.where("names_bits & tags_bits = 0 or not arrays_overlap(names, tags)").select("query_id", "ord")


def located_anchors(requested: DataFrame, stations: DataFrame) -> DataFrame:
    """Coordinates of requested stations that the catalogue locates.

    ``requested(query_id, name)`` -> ``(query_id, name, lat, lon)``.
    """
    found = find_by_name(stations, requested.select("name").distinct())
    spots = found.where("lat is not null and lon is not null").select(
        F.col("asked").alias("name"), "lat", "lon"
    )
    return requested.join(spots, "name").select("query_id", "name", "lat", "lon")


# --- map elements -----------------------------------------------------------------------------


def is_station_node(tags: str = "tags") -> Column:
    """A named node that is a stop of some kind."""
    railway = ", ".join(f"'{v}'" for v in STATION_RAILWAY)
    transport = ", ".join(f"'{v}'" for v in STATION_TRANSPORT)
    return F.expr(
        f"coalesce({tags}['name'], '') <> '' and (coalesce({tags}['railway'] in ({railway}), false)"
        f" or coalesce({tags}['public_transport'] in ({transport}), false))"
    )


def line_label(tags: str = "tags") -> Column:
    """P5: canonical line of a route relation, NULL when there is none."""
    field = "trim(coalesce({0}['{1}'], ''))"
    network, ref, route, name = (field.format(tags, f) for f in ("network", "ref", "route", "name"))
    bare = f"trim(regexp_replace(trim(regexp_extract({name}, '^(.*?)(\\\\s*[:(]|$)', 1)), '(?iU)\\\\s+линия$', ''))"
    return F.expr(
        f"case when {network} = '{DIAMETER_NETWORK}' then"
        f" case when rlike({ref}, '(?i)^D\\\\d+') then concat('{DIAMETER_NETWORK}-', regexp_extract({ref}, '(?i)^D(\\\\d+)', 1)) end"
        f" when {route} = 'train' and {ref} = '{RING_REF}' then '{RING_LABEL}'"
        f" when {route} = 'subway' then nullif({bare}, '') end"
    )


def _line_nodes(elements: DataFrame) -> DataFrame:
    """``(relation_id, label, node_id)`` of the nodes of lines."""
    return (
        elements.where("type = 'relation'")
        .withColumn("label", line_label())
        .where("label is not null")
        .select(F.col("id").alias("relation_id"), "label", F.explode("members").alias("m"))
        .where("m.type = 'node'")
        .select("relation_id", "label", F.col("m.ref").alias("node_id"))
    )


def _station_nodes(elements: DataFrame) -> DataFrame:
    return elements.where(
        (F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & is_station_node()
    ).select(
        F.col("id").alias("node_id"), F.expr("trim(tags['name'])").alias("name"), "tags", "lat", "lon"
    )


def relation_members(elements: DataFrame) -> DataFrame:
    """``(relation_id, label, node_id, name, tags, lat, lon)`` of station nodes of lines."""
    return _line_nodes(elements).join(_station_nodes(elements), "node_id")


def stations_from_osm(elements: DataFrame) -> DataFrame:
    """A3: one station per name key: all line labels and aliases, the place of the lowest node.

    Relations that call at a node are far more than lines: nodes meet the different labels of theirs, once each.
    """
    calls = through_table(_line_nodes(elements).select("label", "node_id").distinct(), "line-nodes")
    nodes = _station_nodes(elements).withColumn("key", normalize_key("name"))
    places = calls.join(nodes.drop("tags"), "node_id").groupBy("key").agg(
        F.expr("min_by(struct(name, lat, lon), node_id)").alias("p"),
        F.array_join(F.array_sort(F.collect_set("label")), LINE_SEPARATOR).alias("line"),
    )
    raw = F.expr(
        "flatten(transform(array(tags['alt_name'], tags['short_name']), t -> split(coalesce(t, ''), ';')))"
    )
    aliases = (
        nodes.join(calls, "node_id", "left_semi")
        .select("key", "node_id", F.posexplode(raw).alias("seq", "alias"))
        .withColumn("alias", F.trim("alias"))
        .withColumn("alias_key", normalize_key("alias"))
        .where("alias_key <> '' and alias_key <> key")
        .groupBy("key", "alias_key")
        .agg(F.expr("min_by(alias, struct(node_id, seq))").alias("alias"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    )
    return places.join(aliases, "key", "left").select(
        "key", "p.name", "p.lat", "p.lon", "line",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
    )


# --- provider feed ----------------------------------------------------------------------------


def dedupe_first(entries: DataFrame) -> DataFrame:
    """The first entry per name key (by ``ord``)."""
    rest = [c for c in entries.columns]
    return (
        entries.groupBy(normalize_key("name").alias("_key"))
        .agg(F.min_by(F.struct(*rest), F.col("ord")).alias("e"))
        .select("e.*")
    )


def complexes_from_feed(feed: DataFrame) -> DataFrame:
    """Complexes; the county is known only inside the capital."""
    rows = feed.where("coalesce(name, '') <> ''").select(
        F.col("pos").alias("ord"),
        "name",
        F.expr("nullif(trim(both '/' from coalesce(url, '')), '')").alias("slug"),
        F.col("id").cast("string").alias("id"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "district",
        F.expr(f"case when locations.parent.name = '{CAPITAL}' then locations.child.name end").alias("county"),
        "metro",
    )
    return dedupe_first(rows)


def counties_from_feed(feed: DataFrame) -> DataFrame:
    rows = feed.where(
        f"locations.parent.name = '{CAPITAL}' and coalesce(locations.child.name, '') <> ''"
    ).select(
        F.col("pos").alias("ord"),
        F.col("locations.child.name").alias("name"),
        F.expr("nullif(locations.child.url, '')").alias("slug"),
        F.col("locations.child.id").cast("string").alias("id"),
    )
    return dedupe_first(rows)


def metro_from_feed(feed: DataFrame) -> DataFrame:
    return dedupe_first(
        feed.where("coalesce(metro, '') <> ''").select(F.col("pos").alias("ord"), F.col("metro").alias("name"))
    )


def districts_from_feed(feed: DataFrame) -> DataFrame:
    return dedupe_first(
        feed.where("coalesce(district, '') <> ''").select(
            F.col("pos").alias("ord"), F.col("district").alias("name")
        )
    )


FEED_PROJECTIONS = {
    "complexes": complexes_from_feed,
    "counties": counties_from_feed,
    "metro": metro_from_feed,
    "districts": districts_from_feed,
}

MERGED_FIELDS = ("slug", "id", "lat", "lon", "district", "county", "metro")


def link_records(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """``(f_ord, ord, by_slug)``: slug match first (last entry of a slug), else name or alias.

    Rows of ``fetched`` without a partner are absent.
    """
    slugs = existing.where("coalesce(slug, '') <> ''").groupBy("slug").agg(F.max("ord").alias("slug_ord"))
    names = name_keys(existing).groupBy("key").agg(F.min("ord").alias("name_ord"))
    return (
        fetched.select(F.col("ord").alias("f_ord"), "slug", normalize_key("name").alias("key"))
        .join(slugs, "slug", "left")
        .join(names, "key", "left")
        .select(
            "f_ord",
            F.coalesce("slug_ord", "name_ord").alias("ord"),
            F.col("slug_ord").isNotNull().alias("by_slug"),
        )
        .where("ord is not null")
    )


def merge_catalog(existing: DataFrame, fetched: DataFrame, kind: str = "") -> DataFrame:
    """Fetched values win where non-empty; names only through a slug match.

    ``existing`` has the catalogue columns and ``ord``; ``fetched`` any subset with ``ord``.
    Curated fields stay. Rows without a partner are appended, except stations. ``ord`` of the
    result is the old one; use ``file_order`` for the new file order.
    """
    for field in MERGED_FIELDS:
        if field not in fetched.columns:
            kind_of = existing.schema[field].dataType if field in existing.columns else "string"
            fetched = fetched.withColumn(field, F.lit(None).cast(kind_of))
    links = link_records(existing, fetched)
    clean = {f: f"nullif({f}, 0)" if f in ("lat", "lon") else f"nullif({f}, '')" for f in MERGED_FIELDS}
    news = (
        links.join(fetched.withColumnRenamed("ord", "f_ord"), "f_ord")
        .groupBy("ord")
        .agg(
            F.expr("max_by(name, f_ord) filter (where by_slug)").alias("new_name"),
            *[
                F.expr(f"max_by({e}, f_ord) filter (where {e} is not null)").alias(f"new_{f}")
                for f, e in clean.items()
            ],
        )
    )
    updated = existing.join(news, "ord", "left").select(
        *[
            F.coalesce(f"new_{c}", c).alias(c) if c in ("name", *MERGED_FIELDS) else F.col(c)
            for c in existing.columns
        ]
    )
    if kind == "metro":
        return updated
    fresh = fetched.join(
        links.select(F.col("f_ord").alias("ord")), "ord", "left_anti"
    ).drop("ord")
    added = fresh.select([c for c in existing.columns if c in fresh.columns])
    merged = updated.unionByName(added, allowMissingColumns=True)
    return merged.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def refresh_all(feed: DataFrame, catalogs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Feed -> projections -> merged catalogues per kind."""
    return {
        kind: merge_catalog(catalogs[kind], project(feed), kind)
        for kind, project in FEED_PROJECTIONS.items()
    }


# --- stations ---------------------------------------------------------------------------------


def link_stations(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """``(key, ord, priority)``: equal name 0, alias not shadowed by a name 1, similar text 2.

    ``fetched(key, …)``. Of equally similar texts the last one in file order wins.
    """
    keys = name_keys(existing)
    names = keys.where("is_name").groupBy("key").agg(F.min("ord").alias("ord"))
    aliases = (
        keys.where("not is_name").join(names, "key", "left_anti").groupBy("key").agg(F.min("ord").alias("ord"))
    )
    exact = names.withColumn("priority", F.lit(0)).unionByName(aliases.withColumn("priority", F.lit(1)))
    asked = fetched.select("key").distinct()
    hits = asked.join(exact, "key").select("key", "ord", "priority")
    rest = asked.join(exact, "key", "left_anti").where(f"length(key) >= {FUZZY_MIN_LENGTH}")
    long_keys = keys.where(f"length(key) >= {FUZZY_MIN_LENGTH}")
    pairs = similar_pairs(
        rest.withColumnRenamed("key", "a"), long_keys.select(F.col("key").alias("b")), FUZZY_THRESHOLD
    )
    spelled = long_keys.groupBy(F.col("key").alias("b")).agg(
        F.max(F.struct("ord", "seq")).alias("place")
    )
    best = (
        pairs.join(spelled, "b")
        .groupBy(F.col("a").alias("key"))
        .agg(F.expr("max_by(place.ord, struct(score, place))").alias("ord"))
        .withColumn("priority", F.lit(2))
    )
    return hits.unionByName(best)


def merge_stations(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """U8: lines are united, coordinates come from the best match, unmatched stations appended.

    Adds ``added`` (the row is new). ``fetched(key, name, lat, lon, line, aliases)``.
    """
    # Both the updated and the appended rows need the links; they are computed once.
    links = through_table(link_stations(existing, fetched), "station-links")
    split = "filter(transform(split(coalesce(line, ''), ' / '), x -> trim(x)), x -> x <> '')"
    news = (
        links.join(fetched, "key")
        .groupBy("ord")
        .agg(
            F.expr(f"array_distinct(flatten(collect_list({split})))").alias("new_lines"),
            F.expr(
                "min_by(struct(lat, lon), struct(priority, key)) filter (where lat is not null)"
            ).alias("spot"),
        )
    )
    lines = F.expr(
        f"nullif(array_join(array_sort(array_union({split}, new_lines)), '{LINE_SEPARATOR}'), '')"
    )
    updated = (
        existing.join(news, "ord", "left")
        .withColumn("line", F.when(F.col("new_lines").isNotNull(), F.coalesce(lines, "line")).otherwise(F.col("line")))
        .withColumn("lat", F.coalesce("spot.lat", "lat"))
        .withColumn("lon", F.coalesce("spot.lon", "lon"))
        .select(*existing.columns)
        .withColumn("added", F.lit(False))
    )
    fresh = fetched.join(links.select("key"), "key", "left_anti")
    added = fresh.select([c for c in existing.columns if c in fresh.columns]).withColumn("added", F.lit(True))
    return updated.unionByName(added, allowMissingColumns=True)


def refresh_stations(elements: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Map elements -> merged stations and their six summary counts."""
    fetched = through_table(stations_from_osm(elements), "stations")
    merged = merge_stations(existing, fetched)
    counts = merged.agg(
        F.count(F.lit(1)).alias("total"),
        F.expr("count_if(added)").alias("added"),
        F.expr("count_if(lat is not null)").alias("with_coords"),
        F.expr("count_if(coalesce(line, '') <> '')").alias("with_line"),
        F.expr(f"count_if(contains(line, '{DIAMETER_NETWORK}'))").alias("diameter"),
    ).withColumn("one", F.lit(1))
    found = fetched.agg(F.count(F.lit(1)).alias("fetched")).withColumn("one", F.lit(1))
    return merged, counts.join(found, "one").drop("one")


# --- curation and quality ---------------------------------------------------------------------


def curation_errors(entries: DataFrame, delete: DataFrame, merge: DataFrame, rename: DataFrame) -> DataFrame:
    """U9 checks: ``(name, problem)``: names that are not there, merges that would lose an id."""
    asked = (
        delete.select("name")
        .unionByName(merge.select(F.col("duplicate").alias("name")))
        .unionByName(rename.select(F.col("old").alias("name")))
        .distinct()
    )
    unknown = asked.join(entries.select("name"), "name", "left_anti").withColumn("problem", F.lit("unknown"))
    kept_ids = (
        merge.select(F.col("duplicate").alias("name"))
        .join(entries.where("coalesce(id, '') <> '' or coalesce(slug, '') <> ''"), "name", "left_semi")
        .withColumn("problem", F.lit("has_id"))
    )
    no_target = (
        merge.select(F.col("target").alias("name"))
        .join(entries.select("name"), "name", "left_anti")
        .withColumn("problem", F.lit("unknown_target"))
    )
    return unknown.unionByName(kept_ids).unionByName(no_target).distinct()


def apply_curation(
    entries: DataFrame, delete: DataFrame, merge: DataFrame, rename: DataFrame
) -> DataFrame:
    """Drop, fold duplicates into target aliases, rename keeping the old name as alias.

    ``delete(name)``, ``merge(duplicate, target, extra_alias)``, ``rename(old, new)``. If
    ``curation_errors`` has rows nothing is applied: the query fails and names their number.
    """
    errors = curation_errors(entries, delete, merge, rename).agg(F.count(F.lit(1)).alias("n"))
    folded = (
        merge.join(entries.select(F.col("name").alias("duplicate"), "aliases"), "duplicate")
        .select(
            F.col("target").alias("name"),
            F.expr(
                "array_compact(concat(array(duplicate), aliases, array(extra_alias)))"
            ).alias("gained"),
        )
        .groupBy("name")
        .agg(F.flatten(F.array_sort(F.collect_list("gained"))).alias("gained"))
    )
    gone = delete.select("name").unionByName(merge.select(F.col("duplicate").alias("name"))).distinct()
    named = rename.select(F.col("old").alias("name"), "new")
    fresh = (
        "filter(extra, (x, i) -> not array_contains(known, keys[i])"
        " and keys[i] <> '' and array_position(keys, keys[i]) = i + 1)"
    )
    out = (
        entries.join(gone, "name", "left_anti")
        .join(folded, "name", "left")
        .join(named, "name", "left")
        .withColumn(
            "extra",
            F.expr(
                "concat(coalesce(gained, cast(array() as array<string>)),"
                " case when new is not null then array(name) else cast(array() as array<string>) end)"
            ),
        )
        .withColumn("keys", F.transform("extra", normalize_key))
        .withColumn(
            "known",
            F.concat(
                F.transform("aliases", normalize_key), F.array(normalize_key(F.coalesce("new", "name")))
            ),
        )
        .withColumn("aliases", F.expr(f"concat(aliases, {fresh})"))
        .withColumn("name", F.coalesce("new", "name"))
        .withColumn("one", F.lit(1))
    )
    checked = errors.withColumn("one", F.lit(1))
    stop = F.raise_error(F.concat(F.lit("curation errors: "), F.col("n").cast("string")))
    sound = F.when(F.col("n") > 0, stop.cast("boolean")).otherwise(F.lit(True))
    return out.join(F.broadcast(checked), "one").where(sound).select(*entries.columns)


def catalog_quality(entries: DataFrame, baseline: DataFrame, allowed: DataFrame, removed: DataFrame) -> DataFrame:
    """``(problem, subject, n)``.

    Duplicate name keys, duplicate ids, orphans (no coordinates, slug, id and not in
    ``allowed(name)``), ids of ``baseline(id)`` that were lost, ids of ``removed(id)`` that came
    back, and a shrunken number of ids.
    """
    def rows(df: DataFrame, problem: str, subject: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), F.col(subject).cast("string").alias("subject"), "n")

    count = F.count(F.lit(1)).alias("n")
    with_id = entries.where("coalesce(id, '') <> ''")
    names = entries.groupBy(normalize_key("name").alias("key")).agg(count).where("n > 1")
    ids = with_id.groupBy("id").agg(count).where("n > 1")
    orphans = (
        entries.where("lat is null and lon is null and coalesce(slug, '') = '' and coalesce(id, '') = ''")
        .join(allowed.select("name"), "name", "left_anti")
        .groupBy("name")
        .agg(count)
    )
    lost = (
        baseline.select("id").distinct().join(with_id, "id", "left_anti").join(removed, "id", "left_anti")
    ).withColumn("n", F.lit(1).cast("long"))
    back = removed.select("id").distinct().join(with_id, "id", "left_semi").withColumn("n", F.lit(1).cast("long"))
    now = with_id.agg(count).withColumn("one", F.lit(1))
    before = baseline.join(removed, "id", "left_anti").agg(F.count(F.lit(1)).alias("was")).withColumn("one", F.lit(1))
    shrunk = now.join(before, "one").where("n < was").select("was", "n")
    return (
        rows(names, "duplicate_name", "key")
        .unionByName(rows(ids, "duplicate_id", "id"))
        .unionByName(rows(orphans, "orphan", "name"))
        .unionByName(rows(lost, "lost_id", "id"))
        .unionByName(rows(back, "returned_id", "id"))
        .unionByName(rows(shrunk, "fewer_ids", "was"))
    )


# --- trust and warnings -----------------------------------------------------------------------


def is_trusted_id(entries: DataFrame, distrusted: DataFrame) -> DataFrame:
    """Adds ``trusted``: a non-empty id that is not in ``distrusted(id)``."""
    bad = distrusted.select("id").distinct().withColumn("bad", F.lit(True))
    return (
        entries.join(bad, "id", "left")
        .withColumn("trusted", F.expr("coalesce(id, '') <> '' and bad is null"))
        .select(*entries.columns, "trusted")
    )


def needs_geo_fallback(kind: str = "kind") -> Column:
    """P7 on rows ``(kind, slug, id, trusted)``."""
    return F.expr(
        f"case {kind} when 'metro' then coalesce(slug, '') = '' and not trusted"
        " when 'counties' then coalesce(slug, '') = '' and coalesce(id, '') = ''"
        " when 'districts' then coalesce(id, '') = '' else false end"
    )


def missing_id_warning(entities: DataFrame) -> DataFrame:
    """``(query_id, kind, name, code)`` of entities that cannot reach the link.

    ``entities(query_id, kind, name, slug, id, trusted)``. With several locations, and always for
    districts and complexes, an id is needed; otherwise slug or id. Entities the location fallback
    handles are silent.
    """
    totals = entities.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    code = F.expr(
        "case when total > 1 or kind in ('districts', 'complexes') then"
        " case when coalesce(id, '') = '' then 'no_id' end"
        " when coalesce(slug, '') = '' and coalesce(id, '') = '' then 'no_slug_or_id' end"
    )
    return (
        entities.join(totals, "query_id")
        .withColumn("code", code)
        .where(F.col("code").isNotNull() & ~needs_geo_fallback())
        .select("query_id", "kind", "name", "code")
    )
