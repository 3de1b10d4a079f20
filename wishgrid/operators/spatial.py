"""Distance joins, nearest neighbours and point-in-ring.

All joins are equi-joins on cells of a three-dimensional grid around the sphere, so there are no
poles, no date line and no nested loop. Work is done on *distinct coordinates* and carried back to
the rows afterwards: a coordinate shared by a third of all rows is compared once.  Cells that hold
many coordinates are split by a salt that the other side replicates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wishgrid.functions.geo import EARTH_RADIUS_M, haversine_m, to_xyz
from wishgrid.functions.text import normalize_key
from wishgrid.operators.skew import FEW, PACK, in_arrays, join_split
from wishgrid.session import through_table

CELL_TARGET = 4096  # coordinates of one cell handled by one task; more are split by a salt
SLACK_M = 0.5  # widens the searched box, never the accepted radius
LEVEL_BASE_M = 128.0
LEVELS = 18  # LEVEL_BASE_M * 2**17 exceeds the diameter of the sphere


def chord_m(arc_m: float | Column) -> float | Column:
    """Straight-line length of an arc on the sphere."""
    if isinstance(arc_m, Column):
        half = F.least(arc_m / (2 * EARTH_RADIUS_M), F.lit(math.pi / 2))
        return F.lit(2 * EARTH_RADIUS_M) * F.sin(half)
    return 2 * EARTH_RADIUS_M * math.sin(min(arc_m / (2 * EARTH_RADIUS_M), math.pi / 2))


def _cell(width: float | Column) -> list[Column]:
    return [F.floor(F.col(a) / width).alias("c" + a) for a in "xyz"]


def _cover(df: DataFrame, reach: float | Column, width: float | Column) -> DataFrame:
    """One row per cell that the box of half-size ``reach`` around the point touches."""
    for a in "xyz":
        low = F.floor((F.col(a) - reach) / width)
        high = F.floor((F.col(a) + reach) / width)
        df = df.withColumn("c" + a, F.explode(F.sequence(low, high)))
    return df


def _coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    x, y, z = to_xyz(F.col(lat), F.col(lon))
    located = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return (
        located.select(lat, lon)
        .distinct()
        .select(lat, lon, x.alias("x"), y.alias("y"), z.alias("z"))
    )


def _join_cells(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return join_split(left, right, keys, ["q_lat", "q_lon"], CELL_TARGET)


def coordinate_pairs(points: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """Distinct coordinate pairs within ``radius_m`` (inclusive).

    Inputs carry ``p_lat, p_lon`` and ``q_lat, q_lon``; the result adds ``dist_m``.
    """
    reach = chord_m(radius_m) + SLACK_M
    width = 2.0 * reach
    keys = ["cx", "cy", "cz"]
    p = _cover(_coordinates(points, "p_lat", "p_lon"), reach, width).select("p_lat", "p_lon", *keys)
    q = _coordinates(places, "q_lat", "q_lon").select("q_lat", "q_lon", *_cell(width))
    dist = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("q_lat"), F.col("q_lon"))
    return (
        _join_cells(p, q, keys)
        .select("p_lat", "p_lon", "q_lat", "q_lon", dist.alias("dist_m"))
        .where(F.col("dist_m") <= radius_m)
    )


def _as_points(points: DataFrame) -> DataFrame:
    return points.select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))


def _as_places(places: DataFrame) -> DataFrame:
    return places.select(
        "place_id", "ord", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")
    )


def radius_join(points: DataFrame, places: DataFrame, radius_m: float, digits: int | None = None) -> DataFrame:
    """Every ``(point_id, place_id, ord, dist_m)`` within ``radius_m``.

    ``points(point_id, lat, lon)``, ``places(place_id, ord, lat, lon)``. ``digits`` rounds the distance, once per pair of
    coordinates. What lies at one coordinate meets the pairs as arrays, taken apart at the end, so their product is not shuffled.
    """
    p, q = _as_points(points), _as_places(places)
    pairs = coordinate_pairs(p, q, radius_m)
    if digits is not None:
        pairs = pairs.withColumn("dist_m", F.round("dist_m", digits))
    met = (
        pairs.join(in_arrays(p, ["p_lat", "p_lon"], FEW, "_ps"), ["p_lat", "p_lon"])
        .join(in_arrays(q, ["q_lat", "q_lon"], PACK, "_qs"), ["q_lat", "q_lon"])
        .select("dist_m", F.explode("_ps").alias("_p"), "_qs")
        .select("dist_m", "_p", F.explode("_qs").alias("_q"))
    )
    return met.select("_p.point_id", "_q.place_id", "_q.ord", "dist_m")


def _nearest_coordinates(p: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """Per distinct point coordinate its ``k`` nearest places, ties by ``ord``.

    A grid with doubling cell widths is counted once. Each point takes the smallest cell around it
    that holds ``k`` places; the k-th neighbour is no farther than that cell's diagonal, which
    bounds the box searched one level up. Exact for any distribution.
    """
    per_spot = Window.partitionBy("q_lat", "q_lon").orderBy("ord", "place_id")
    located = q.where(F.col("q_lat").isNotNull() & F.col("q_lon").isNotNull())
    kept = (
        located.withColumn("spot_rank", F.row_number().over(per_spot))
        .where(F.col("spot_rank") <= k)
        .select("q_lat", "q_lon", "ord", "place_id")
    )
    x, y, z = to_xyz(F.col("q_lat"), F.col("q_lon"))
    spots = (
        located.groupBy("q_lat", "q_lon")
        .agg(F.count(F.lit(1)).alias("held"))
        .select("q_lat", "q_lon", "held", x.alias("x"), y.alias("y"), z.alias("z"))
    )
    p_xyz = _coordinates(p, "p_lat", "p_lon")

    keys = ["level", "cx", "cy", "cz"]
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    width = F.lit(LEVEL_BASE_M) * F.pow(F.lit(2.0), F.col("level"))
    filled = (
        spots.withColumn("level", levels)
        .select("level", "held", *_cell(width))
        .groupBy(*keys)
        .agg(F.sum("held").alias("held"))
        .where((F.col("held") >= k) | (F.col("level") == LEVELS - 1))
    )
    chosen = (
        p_xyz.withColumn("level", levels)
        .select("p_lat", "p_lon", "x", "y", "z", "level", *_cell(width))
        .join(filled.drop("held"), keys)
        .groupBy("p_lat", "p_lon", "x", "y", "z")
        .agg(F.min("level").alias("own"))
    )
    reach = F.lit(LEVEL_BASE_M * math.sqrt(3.0)) * F.pow(F.lit(2.0), F.col("own")) + SLACK_M
    top = F.lit(LEVELS - 1)
    search = _cover(
        chosen.withColumn("level", F.least(F.col("own") + 1, top)), reach, width
    ).select("p_lat", "p_lon", *keys)
    targets = spots.withColumn("level", levels).select("q_lat", "q_lon", "level", *_cell(width))
    dist = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("q_lat"), F.col("q_lon"))
    pairs = _join_cells(search, targets, keys).select(
        "p_lat", "p_lon", "q_lat", "q_lon", dist.alias("dist_m")
    )
    # The k nearest coordinates hold the k nearest places, because ties keep their lowest ord.
    near = Window.partitionBy("p_lat", "p_lon").orderBy("dist_m")
    few = pairs.withColumn("r", F.rank().over(near)).where(F.col("r") <= k).drop("r")
    ranked = Window.partitionBy("p_lat", "p_lon").orderBy("dist_m", "ord", "place_id")
    return (
        few.join(kept, ["q_lat", "q_lon"])
        .withColumn("rn", F.row_number().over(ranked))
        .where(F.col("rn") <= k)
        .select("p_lat", "p_lon", "place_id", "ord", "dist_m", "rn")
    )


def nearest_k(points: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest places of every point, ties by ``ord``."""
    p, q = _as_points(points), _as_places(places)
    near = _nearest_coordinates(p, q, k)
    return p.join(near, ["p_lat", "p_lon"]).select("point_id", "place_id", "ord", "dist_m", "rn")


def radius_or_nearest(
    points: DataFrame, places: DataFrame, radius_m: float = 1500.0, k: int = 8
) -> DataFrame:
    """All places within the radius; a point without any takes its ``k`` nearest.

    Adds ``within`` (the radius sufficed) and ``nearest_m`` per point.
    """
    p, q = _as_points(points), _as_places(places)
    inside = coordinate_pairs(p, q, radius_m)
    spot = ["p_lat", "p_lon"]
    nearest = inside.groupBy(*spot).agg(F.min("dist_m").alias("nearest_m"))
    hits = (
        p.join(inside, spot)
        .join(nearest, spot)
        .join(q, ["q_lat", "q_lon"])
        .select("point_id", "place_id", "ord", "dist_m", "nearest_m", F.lit(True).alias("within"))
    )
    lonely = p.join(nearest, spot, "left_anti")
    # At most k rows per coordinate are left here, so this window is over a bounded group.
    near = _nearest_coordinates(lonely, q, k).withColumn(
        "nearest_m", F.min("dist_m").over(Window.partitionBy(*spot))
    )
    rest = (
        lonely.join(near, spot)
        .select("point_id", "place_id", "ord", "dist_m", "nearest_m", F.lit(False).alias("within"))
    )
    return hits.unionByName(rest)


SET_TARGETS = 64  # a group of so many targets travels as one array, one of more is searched in cells


def with_nearest(spots: DataFrame, targets: DataFrame, group: str) -> DataFrame:
    """``to_nearest``, equal rows of ``spots`` become one."""
    return to_nearest(spots.distinct(), targets, group)


def to_nearest(spots: DataFrame, targets: DataFrame, group: str) -> DataFrame:
    """Every row of ``spots`` with ``dist_m`` to the nearest target of its group and ``pointed``: the group has any.

    ``spots(group, lat, lon, …)``, ``targets(group, lat, lon)``. Exact.
    What lies nowhere is no target and has no distance. Up to ``SET_TARGETS`` targets of a group meet a spot as one array, so
    nothing is multiplied and no task holds its spots; groups of more are searched in cells, which are split where they are crowded.
    """
    located = "lat is not null and lon is not null"
    q = targets.where(located).select(group, F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")).distinct()
    many = q.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SET_TARGETS).select(group)

    def direct(asked: DataFrame, among: DataFrame) -> DataFrame:
        sets = among.groupBy(group).agg(F.collect_list(F.struct("q_lat", "q_lon")).alias("_targets"))
        dist = F.transform("_targets", lambda t: haversine_m(t["q_lat"], t["q_lon"], F.col("lat"), F.col("lon")))
        return asked.join(sets, group, "left").select(
            *spots.columns, F.array_min(dist).alias("dist_m"), F.col("_targets").isNotNull().alias("pointed")
        )

    if many.isEmpty():
        return direct(spots, q)
    crowded = spots.join(many, group, "left_semi")
    near = _nearest_in_cells(
        crowded.where(located).select(group, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).distinct(),
        q.join(many, group, "left_semi"),
        group,
    )
    searched = crowded.join(near, [group, "lat", "lon"], "left").select(*spots.columns, "dist_m", F.lit(True).alias("pointed"))
    return direct(spots.join(many, group, "left_anti"), q.join(many, group, "left_anti")).unionByName(searched)


def _nearest_in_cells(p: DataFrame, q: DataFrame, group: str) -> DataFrame:
    """``(group, lat, lon, dist_m)`` of distinct spots ``p`` to the nearest of the distinct targets ``q``.

    Cells of doubling width are numbered within their group. Each spot takes the smallest cell around
    it that holds a target, whose diagonal bounds the box searched one level up.
    """
    keys = [group, "level", "cx", "cy", "cz"]
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    width = F.lit(LEVEL_BASE_M) * F.pow(F.lit(2.0), F.col("level"))

    def spread(df: DataFrame, lat: str, lon: str) -> DataFrame:
        x, y, z = to_xyz(F.col(lat), F.col(lon))
        return df.select(group, lat, lon, x.alias("x"), y.alias("y"), z.alias("z"), levels.alias("level"))

    cells = spread(q, "q_lat", "q_lon").select("q_lat", "q_lon", group, "level", *_cell(width))
    own = (
        spread(p, "p_lat", "p_lon")
        .select("p_lat", "p_lon", "x", "y", "z", group, "level", *_cell(width))
        .join(cells.select(*keys).distinct(), keys)
        .groupBy(group, "p_lat", "p_lon", "x", "y", "z")
        .agg(F.min("level").alias("own"))
    )
    reach = F.lit(LEVEL_BASE_M * math.sqrt(3.0)) * F.pow(F.lit(2.0), F.col("own")) + SLACK_M
    search = _cover(own.withColumn("level", F.least(F.col("own") + 1, F.lit(LEVELS - 1))), reach, width)
    dist = haversine_m(F.col("q_lat"), F.col("q_lon"), F.col("p_lat"), F.col("p_lon"))
    near = _join_cells(search.select("p_lat", "p_lon", *keys), cells, keys)
    return near.groupBy(group, F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon")).agg(F.min(dist).alias("dist_m"))


def min_distance(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Least distance of every candidate to any anchor of the same query.

    ``candidates(query_id, place_id, lat, lon)``, ``anchors(query_id, lat, lon)``. Candidates without
    coordinates and queries without located anchors give no row.
    """
    near = to_nearest(candidates.select("query_id", "place_id", "lat", "lon"), anchors, "query_id")
    return near.where("dist_m is not null").groupBy("query_id", "place_id").agg(F.min("dist_m").alias("dist_m"))


REGION_STEP = 8  # how much finer each of the two further grids of a region is


def count_in_reach(anchors: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """``(query_id, inside)``: how many places lie within ``radius_m`` of any anchor of the query.

    ``anchors(query_id, lat, lon)``, ``places(lat, lon)``. Three grids, the first as wide as the
    radius, the others eight times finer each: cells wholly within the radius are answered from their
    counts, cells wholly beyond it drop out, and only places of the cells at the border are measured.
    Queries with nothing in reach give no row.
    """
    reach = chord_m(radius_m)
    fine = (reach + SLACK_M) / REGION_STEP**2
    keys = ["cx", "cy", "cz"]
    located = "lat is not null and lon is not null"
    x, y, z = to_xyz(F.col("lat"), F.col("lon"))
    held = places.where(located).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("held"))
    spots = held.select(F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), "held", x.alias("x"), y.alias("y"), z.alias("z"))
    spots = through_table(spots.select("q_lat", "q_lon", "held", *_cell(F.lit(fine))), "region-places")

    def coarser(df: DataFrame) -> DataFrame:
        """Adds ``px, py, pz``, the cell one grid up."""
        return df.select("*", *[F.floor(F.col("c" + a) / REGION_STEP).alias("p" + a) for a in "xyz"])

    finest = spots.groupBy(*keys).agg(F.sum("held").alias("held"))
    middle = coarser(finest).groupBy(*[F.col("p" + a).alias("c" + a) for a in "xyz"]).agg(F.sum("held").alias("held"))

    def judged(df: DataFrame, width: float) -> DataFrame:
        """Cells of a query that are not wholly out of reach; ``full`` where one anchor reaches all of it."""
        least, most = F.lit(0.0), F.lit(0.0)
        for a in "xyz":
            low, high = F.col("c" + a) * F.lit(width), (F.col("c" + a) + 1) * F.lit(width)
            near = F.greatest(low - F.col(a), F.col(a) - high, F.lit(0.0))
            far = F.greatest(F.col(a) - low, high - F.col(a))
            least, most = least + near * near, most + far * far
        return df.where(F.sqrt(least) <= reach + SLACK_M).withColumn("full", F.sqrt(most) <= reach - SLACK_M)

    who = ["query_id", "p_lat", "p_lon", "x", "y", "z"]
    asked = anchors.where(located).select("query_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), x.alias("x"), y.alias("y"), z.alias("z")).distinct()
    region = _cover(asked, F.lit(reach + SLACK_M), F.lit(fine * REGION_STEP**2)).select(
        *who, *[F.col("c" + a).alias("p" + a) for a in "xyz"]
    )
    answers = []
    for cells, width in ((middle, fine * REGION_STEP), (finest, fine)):
        met = judged(region.join(coarser(cells), ["px", "py", "pz"]), width).select(*who, *keys, "held", "full")
        met = through_table(met, "region-cells")
        full = met.where("full").select("query_id", *keys, "held").distinct()
        answers.append(full.select("query_id", "held"))
        border = met.where("not full").join(full, ["query_id", *keys], "left_anti").select(*who, *keys)
        region = border.select(*who, *[F.col("c" + a).alias("p" + a) for a in "xyz"])
    dist = haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("q_lat"), F.col("q_lon"))
    measured = _join_cells(border, spots, keys).where(dist <= radius_m).select("query_id", "q_lat", "q_lon", "held").distinct()
    every = answers[0].unionByName(answers[1]).unionByName(measured.select("query_id", "held"))
    return every.groupBy("query_id").agg(F.sum("held").alias("inside"))


RING_CELLS = 16  # least number of cells along the longer side of a ring
RING_SLACK_DEG = 1e-9  # widens the cells of an edge beyond rounding, never the ring
RING_LEVELS = (-24, 9)  # cells are 2**level degrees wide
RING_KEYS = ["level", "row", "col"]


def _lon_at(lat: Column) -> Column:
    """Where the edge meets a parallel; NULL for an edge along a parallel."""
    share = (lat - F.col("lat1")) / F.nullif(F.col("lat2") - F.col("lat1"), F.lit(0.0))
    return F.col("lon1") + share * (F.col("lon2") - F.col("lon1"))


def _crosses(lat: Column) -> Column:
    return (F.col("lat1") > lat) != (F.col("lat2") > lat)


def _levelled(edges: DataFrame) -> DataFrame:
    """Adds ``level`` and ``w``, the width of the cells of a ring: about four times the root of its edges along a side.

    So a ring has cells in proportion to its edges, and the edges of a cell grow with the root only.
    """
    ends = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    whole = F.lit(True)
    for end in ends:
        whole &= end.isNotNull() & ~F.isnan(end) & (F.abs(end) <= 360.0)
    extent = F.greatest(F.max("lat1") - F.min("lat1"), F.max("lon1") - F.min("lon1"))
    side = F.greatest(F.lit(float(RING_CELLS)), 4 * F.sqrt(F.count(F.lit(1))))
    low, high = RING_LEVELS
    level = F.least(F.greatest(F.ceil(F.log2(extent / side)), F.lit(low)), F.lit(high)).cast("int")
    widths = (
        edges.groupBy("ring_id")
        .agg(level.alias("level"), F.bool_and(whole).alias("whole"), extent.alias("extent"))
        .where("whole and extent > 0")
        .select("ring_id", "level", F.pow(F.lit(2.0), F.col("level")).alias("w"))
    )
    return edges.select("ring_id", "lat1", "lon1", "lat2", "lon2").join(widths, "ring_id")


def ring_cover(edges: DataFrame) -> DataFrame:
    """Rings as cells ``(level, row, col)``: what decides whether a point of the cell is inside.

    A row without an edge says that the south-east corner of the cell is inside; every edge that
    comes near a cell is a row of it. A cell without any row is outside, one with the corner alone is inside.
    """
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    w = F.col("w")
    ring = _levelled(edges)
    rows = F.sequence(F.floor((low - RING_SLACK_DEG) / w), F.floor((high + RING_SLACK_DEG) / w))
    by_row = ring.withColumn("row", F.explode(rows))
    # The part of the edge that lies in the row of cells.
    ends = [F.least(F.greatest((F.col("row") + i) * w, low), high) for i in (0, 1)]
    flat = F.col("lat1") == F.col("lat2")
    at = [F.when(flat, F.col(c)).otherwise(_lon_at(e)) for c, e in zip(("lon1", "lon2"), ends, strict=True)]
    near = F.sequence(
        F.floor((F.least(*at) - RING_SLACK_DEG) / w), F.floor((F.greatest(*at) + RING_SLACK_DEG) / w)
    )
    kept = ["ring_id", *RING_KEYS, "w", "lat1", "lon1", "lat2", "lon2"]
    bordering = by_row.withColumn("col", F.explode(near)).select(*kept)
    # Corners: along the base of a row of cells a ring is inside between every other pair of crossings.
    base = F.col("row") * w
    eastward = Window.partitionBy("ring_id", "row").orderBy(F.desc("x"))
    between = (
        by_row.where(_crosses(base))
        .select("ring_id", "level", "w", "row", _lon_at(base).alias("x"))
        .withColumn("n", F.row_number().over(eastward))
        .withColumn("west", F.lead("x").over(eastward))
        .where("n % 2 = 1")
    )
    first, last = F.ceil(F.col("west") / w) - 1, F.ceil(F.col("x") / w) - 2
    inside = between.where(first <= last).withColumn("col", F.explode(F.sequence(first, last)))
    return bordering.unionByName(inside.select("ring_id", *RING_KEYS, "w"), allowMissingColumns=True)


def rings_containing(points: DataFrame, edges: DataFrame) -> DataFrame:
    """J8 for many rings: the ``(lat, lon, ring_id)`` of every point inside a ring.

    ``edges(ring_id, lat1, lon1, lat2, lon2)`` of closed rings; several loops of one ring follow the
    even-odd rule, with a half-open test of latitude. Points meet only the cells of a ring (see ``ring_cover``): inside it
    one row answers, at its border the few edges near by. From the corner of the cell, whose side is known, the path to the point goes along the
    cell's east side and then west; every edge crossed changes the side. A crossing is always judged by the edge's
    longitude at the point's or the corner's latitude, so the answer equals that of a ray
    to infinity, to the last bit. Cells with many points are split by a salt.

    Points without coordinates are in no ring, nor is any point in a ring with an edge that has a null or not
    finite coordinate. Repeated points are tested once.
    """
    spots = points.where("lat is not null and lon is not null").select("lat", "lon").distinct()
    cover = ring_cover(edges)
    # At most as many numbers as there are levels.
    levels = [r.level for r in _levelled(edges).select("level").distinct().collect()]
    if not levels:
        return spots.limit(0).join(edges.select("ring_id").limit(0))
    width = F.pow(F.lit(2.0), F.col("level"))
    placed = spots.withColumn("level", F.explode(F.array(*[F.lit(level) for level in sorted(levels)]))).select(
        "lat", "lon", "level", F.floor(F.col("lat") / width).alias("row"), F.floor(F.col("lon") / width).alias("col")
    )
    lat, lon = F.col("lat"), F.col("lon")
    base, side = F.col("row") * F.col("w"), (F.col("col") + 1) * F.col("w")

    def east(end: str) -> Column:
        """Whether the end of the part of the edge between base and point lies east of the cell."""
        at = F.col("lat" + end)
        return (
            F.when(at <= base, _lon_at(base) > side).when(at > lat, _lon_at(lat) > side).otherwise(F.col("lon" + end) > side)
        )

    beyond = ((F.col("lat1") <= base) & (F.col("lat2") <= base)) | ((F.col("lat1") > lat) & (F.col("lat2") > lat))
    along_side = F.when(beyond, False).otherwise(east("1") != east("2"))
    westward = _crosses(lat) & (lon < _lon_at(lat)) & (_lon_at(lat) <= side)
    turns = F.when(F.col("lat1").isNull(), True).otherwise(along_side != westward)
    return (
        join_split(cover, placed, RING_KEYS, ["lat", "lon"], CELL_TARGET)
        .where(turns)
        .groupBy("lat", "lon", "ring_id")
        .agg(F.count(F.lit(1)).alias("turns"))
        .where(F.col("turns") % 2 == 1)
        .select("lat", "lon", "ring_id")
    )


def point_in_ring(points: DataFrame, edges: DataFrame) -> DataFrame:
    """J8 for one ring: ``(place_id, inside)`` of every located point."""
    inside = rings_containing(points, edges).select("lat", "lon", F.lit(True).alias("hit"))
    located = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return located.join(inside.distinct(), ["lat", "lon"], "left").select(
        "place_id", F.coalesce("hit", F.lit(False)).alias("inside")
    )


ANY_STATION = "метро"  # fixed value: the prefix that stands for every located station


def station_points(stations: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Located stations one of whose lines starts with the requested prefix.

    ``stations(ord, name, line, lat, lon)``, ``prefixes(line_prefix)``. Every distinct line is exploded
    into its own prefixes, so "starts with" becomes an equi-join; stations meet only the prefixes that fit
    their line, split where a line has many stations. No side of these joins passes the driver; the spellings
    of the one word for every station do.
    """
    located = stations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn(
        "line", F.coalesce("line", F.lit(""))
    )
    asked = prefixes.select("line_prefix", normalize_key("line_prefix").alias("prefix_key")).distinct()
    lines = F.filter(F.transform(F.split("line", "/"), normalize_key), lambda s: F.length(s) > 0)
    starts = F.flatten(
        F.transform(
            lines, lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, F.lit(1), i))
        )
    )
    known = located.select("line").distinct().select("line", F.explode(F.array_distinct(starts)).alias("prefix_key"))
    some = asked.where(F.col("prefix_key") != ANY_STATION)
    fitting = known.join(some.hint("merge"), "prefix_key").select("line", "line_prefix")
    kept = ["line_prefix", "ord", "name", "lat", "lon"]
    by_line = join_split(fitting, located, ["line"], ["ord"], CELL_TARGET, sorted_=True).select(*kept)
    every = asked.where(F.col("prefix_key") == ANY_STATION).select("line_prefix")
    return by_line.unionByName(located.crossJoin(F.broadcast(every)).select(*kept))
