"""Places of interest: categories, profiles, staleness, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wishgrid.operators.skew import dealt
from wishgrid.operators.spatial import coordinate_pairs
from wishgrid.packs import poi_tags as fixed
from wishgrid.session import through_table


def is_operational(tags: str = "tags") -> Column:
    """Not a building site and no key that announces one."""
    keys = ", ".join(f"'{k}'" for k in fixed.BUILDING_KEYS)
    prefixes = " or ".join(f"startswith(k, '{k}:')" for k in fixed.BUILDING_KEYS)
    return F.expr(
        f"not (coalesce({tags}['landuse'], '') = 'construction'"
        f" or exists(map_keys(coalesce({tags}, map())), k -> k in ({keys}) or {prefixes}))"
    )


def poi_categories(tags: str = "tags") -> Column:
    """Every category the tags fall in; one element may belong to several."""
    tests = []
    for category, rules in fixed.CATEGORY_TAGS.items():
        cond = " or ".join(
            f"coalesce({tags}['{key}'] = '{p[1:-1]}', false)"
            if p.startswith("^")
            else f"coalesce(rlike({tags}['{key}'], '{p}'), false)"
            for key, p in rules
        )
        tests.append(f"case when {cond} then '{category}' end")
    return F.expr(f"array_compact(array({', '.join(tests)}))")


def element_points(elements: DataFrame) -> DataFrame:
    """Elements with a point: own coordinates, else those of the centre; 0 counts as missing."""
    return elements.withColumn("e_lat", F.expr("coalesce(nullif(lat, 0), nullif(center.lat, 0))")).withColumn(
        "e_lon", F.expr("coalesce(nullif(lon, 0), nullif(center.lon, 0))")
    )


def poi_profile(complexes: DataFrame, elements: DataFrame, radius_m: float = fixed.COLLECT_RADIUS_M) -> DataFrame:
    """A1: one record per complex and category; zero records are kept.

    ``complexes(slug, lat, lon)``, ``elements(id, lat, lon, center, tags)``. J10 underneath: the
    elements are first reduced to one row per (coordinate, category), complexes to distinct
    coordinates, and only those meet in the grid.
    """
    placed = (
        element_points(elements)
        .where("e_lat is not null and e_lon is not null")
        .withColumn("works", is_operational())
        .select(
            F.col("id"), F.col("e_lat").alias("q_lat"), F.col("e_lon").alias("q_lon"), "works",
            F.expr("tags['name']").alias("name"), F.explode(poi_categories()).alias("category"),
        )
    )
    spots = placed.groupBy("q_lat", "q_lon", "category").agg(
        F.expr("count_if(works)").alias("n_op"),
        F.expr("count_if(not works)").alias("n_site"),
        F.expr("min_by(named_struct('id', id, 'name', name), id) filter (where works)").alias("op"),
    )
    located = complexes.where("slug is not null and lat is not null and lon is not null").select(
        "slug", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")
    )
    near = coordinate_pairs(located, spots, float(radius_m)).join(spots, ["q_lat", "q_lon"])
    stats = near.groupBy("p_lat", "p_lon", "category").agg(
        F.sum("n_op").alias("count_operational"),
        F.sum("n_site").alias("count_under_construction"),
        F.expr("min(dist_m) filter (where n_op > 0)").alias("closest_distance_m"),
        F.expr("min_by(op.name, struct(dist_m, op.id)) filter (where n_op > 0)").alias("closest_name"),
        F.expr("min(dist_m) filter (where n_site > 0)").alias("closest_under_construction_m"),
    )
    categories = F.array(*[F.lit(c) for c in fixed.CATEGORY_TAGS])
    grid = located.withColumn("category", F.explode(categories))
    return grid.join(stats, ["p_lat", "p_lon", "category"], "left").select(
        "slug",
        "category",
        F.expr("coalesce(count_operational + count_under_construction, 0)").alias("count"),
        "closest_distance_m",
        "closest_name",
        F.expr("closest_distance_m is not null and closest_name is null").alias("closest_unnamed"),
        F.coalesce("count_operational", F.lit(0)).alias("count_operational"),
        F.coalesce("count_under_construction", F.lit(0)).alias("count_under_construction"),
        "closest_under_construction_m",
        F.lit(fixed.SCHEMA_VERSION).alias("schema_version"),
    )


def stale_poi(poi: DataFrame) -> DataFrame:
    """Records of an old version that still state a distance."""
    return poi.where(f"schema_version < {fixed.SCHEMA_VERSION} and closest_distance_m is not null")


def refresh_worklist(complexes: DataFrame, poi: DataFrame) -> DataFrame:
    """(complex, category) without a current record; only located complexes with a slug."""
    categories = F.array(*[F.lit(c) for c in fixed.CATEGORY_TAGS])
    wanted = complexes.where(
        "nullif(lat, 0) is not null and nullif(lon, 0) is not null and coalesce(slug, '') <> ''"
    ).select("slug", "lat", "lon", F.explode(categories).alias("category"))
    fresh = poi.where(f"schema_version >= {fixed.SCHEMA_VERSION}").select("slug", "category")
    return wanted.join(fresh, ["slug", "category"], "left_anti")


def known_presence() -> Column:
    """Presence of a record: operating objects from version 2 on, any object before."""
    return F.expr(
        f"case when schema_version >= {fixed.SCHEMA_VERSION} then count_operational > 0 else count > 0 end"
    )


def poi_evidence(requirements: DataFrame, matched: DataFrame, poi: DataFrame) -> DataFrame:
    """A2: per requirement the nearest matched complex and what is known about its object.

    ``requirements(query_id, category)``, ``matched(query_id, slug, ord)``.
    """
    matched = through_table(matched.select("query_id", "slug", "ord"), "matched")
    n = matched.count()
    asked = dealt(matched, n, "query_id").join(requirements.distinct(), "query_id")
    rows = dealt(asked, n, "slug", "category").join(poi, ["slug", "category"])
    stats = dealt(rows, n, "query_id", "category").groupBy("query_id", "category").agg(
        F.expr(
            "min_by(struct(slug, closest_distance_m, closest_name, closest_unnamed, schema_version,"
            " closest_under_construction_m), struct(closest_distance_m, ord))"
            " filter (where closest_distance_m is not null)"
        ).alias("n"),
        F.sum("count_under_construction").alias("under_construction"),
    )
    label = (
        "case when n.closest_name <> '' then 'named' when n.closest_unnamed then 'unnamed' else 'not_recorded' end"
    )
    return stats.where("n is not null").select(
        "query_id",
        "category",
        "n.slug",
        F.col("n.closest_distance_m").alias("distance_m"),
        F.col("n.closest_name").alias("object_name"),
        F.expr(label).alias("object_label"),
        F.expr(f"n.schema_version >= {fixed.SCHEMA_VERSION}").alias("current"),
        "under_construction",
        F.expr(
            "under_construction > 0 and coalesce(n.closest_under_construction_m < n.closest_distance_m, false)"
        ).alias("site_is_closer"),
    )


def uncollected_categories(requirements: DataFrame, candidates: DataFrame, poi: DataFrame) -> DataFrame:
    """Requested categories no candidate of the query has a record for."""
    asked = requirements.select("query_id", "category").distinct()
    served = candidates.select("query_id").distinct()
    known = candidates.select("query_id", "slug").join(poi.select("slug", "category"), "slug")
    return asked.join(served, "query_id", "left_semi").join(known, ["query_id", "category"], "left_anti")
