"""Travel: modes, estimates, routes, destinations and origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wishgrid.functions.geo import CENTRE_LAT, CENTRE_LON, haversine_m
from wishgrid.operators.catalog import find_by_name
from wishgrid.operators.skew import join_packed, join_split

# Metres per minute, winding factor and fixed minutes per mode.
MODES = {
    "pedestrian": (83.33, 1.25, 0),
    "driving": (500.0, 1.35, 0),
    "transit": (333.33, 1.3, 3),
    "bicycle": (250.0, 1.2, 0),
}
KEPT_ROUTES = 10

# Words that name a mode.
CAR_WORDS = ["машин", "авто", "автомобил"]
CAR_PHRASES = ["на машине", "на авто", "на автомобиле", "на такси"]
TRANSIT_PHRASES = ["на транспорте", "на автобусе", "на метро"]
BICYCLE_PHRASES = ["велосипед", "самокат", "на веле"]


def travel_mode() -> Column:
    """P11 on columns ``text, time_on_transport, time_on_foot``."""

    def says(words: list[str]) -> str:
        return "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"

    return F.expr(
        f"case when time_on_transport is not null then case when {says(CAR_WORDS)} then 'driving' else 'transit' end"
        " when time_on_foot is not null then 'pedestrian'"
        f" when {says(CAR_PHRASES)} then 'driving' when {says(TRANSIT_PHRASES)} then 'transit'"
        f" when {says(BICYCLE_PHRASES)} then 'bicycle' else 'pedestrian' end"
    )


def zoom_band(distance: str = "distance_m") -> Column:
    """P12."""
    return F.expr(
        f"case when {distance} < 1500 then 15 when {distance} < 4000 then 14 when {distance} < 10000 then 12"
        f" when {distance} < 25000 then 11 else 10 end"
    )


def travel_estimate(pairs: DataFrame) -> DataFrame:
    """``pairs(lat1, lon1, lat2, lon2, mode)`` -> adds ``distance_m`` and ``duration_min``."""
    speed, winding, extra = (
        "case mode " + " ".join(f"when '{m}' then {v[i]}D" for m, v in MODES.items()) + f" else {MODES['pedestrian'][i]}D end"
        for i in range(3)
    )
    direct = haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return (
        pairs.withColumn("distance_m", direct * F.expr(winding))
        .withColumn(
            "duration_min",
            F.expr(f"greatest(1, cast(bround(distance_m / ({speed}) + ({extra}), 0) as int))"),
        )
    )


def all_modes(pairs: DataFrame) -> DataFrame:
    """Every pair in all four modes."""
    return travel_estimate(pairs.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES]))))


def best_route(routes: DataFrame) -> DataFrame:
    """Per query the ten fastest routes, with the chosen one flagged.

    ``routes(query_id, ord, duration_min, max_min)``: the fastest one, which is within the limit
    whenever any is.
    """
    order = Window.partitionBy("query_id").orderBy("duration_min", "ord")
    return (
        routes.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= KEPT_ROUTES)
        .withColumn("chosen", F.col("rank") == 1)
        .withColumn("within_limit", F.expr("max_min is null or duration_min <= max_min"))
    )


def destination(
    criteria: DataFrame, landmarks: DataFrame, requested: DataFrame, stations: DataFrame, catalog: DataFrame
) -> DataFrame:
    """First landmark, else first located station, else a landmark named in the text, else the centre.

    ``criteria(query_id, text, center_requested)``, ``landmarks(query_id, pos, name, lat, lon)``,
    ``requested(query_id, pos, name)``, ``catalog(ord, name, aliases, lat, lon)`` of landmarks.
    Names meet texts where the text holds their beginning (see ``named_in_text``).
    """
    spot = F.struct("name", "lat", "lon")
    by_landmark = landmarks.groupBy("query_id").agg(F.min_by(spot, F.col("pos")).alias("p")).withColumn("prio", F.lit(0))
    found = find_by_name(stations, requested.select("name").distinct()).where("lat is not null and lon is not null")
    located = requested.join(found.select(F.col("asked").alias("name"), "lat", "lon"), "name")
    by_station = located.groupBy("query_id").agg(F.min_by(spot, F.col("pos")).alias("p")).withColumn("prio", F.lit(1))
    by_text = named_in_text(criteria, catalog).select("query_id", spot.alias("p")).withColumn("prio", F.lit(2))
    centre = F.struct(
        F.lit("centre").alias("name"), F.lit(CENTRE_LAT).alias("lat"), F.lit(CENTRE_LON).alias("lon")
    )
    by_centre = criteria.where("center_requested").select("query_id", centre.alias("p")).withColumn("prio", F.lit(3))
    every = by_landmark.unionByName(by_station).unionByName(by_text).unionByName(by_centre)
    return every.groupBy("query_id").agg(F.min_by("p", "prio").alias("p"), F.min("prio").alias("prio")).select(
        "query_id", "p.*", "prio"
    )


CONTAINED_PREFIX = 4


def named_in_text(criteria: DataFrame, catalog: DataFrame) -> DataFrame:
    """First landmark (by ``ord``) whose name or alias occurs in the lower-cased text.

    Distinct names are known by their first ``CONTAINED_PREFIX`` characters (shorter ones by all) and their lengths.
    Where a distinct text holds such a beginning, the piece of that length is looked up as a whole, so names that begin
    alike are not compared one by one.
    """
    low = F.transform(F.concat(F.array("name"), "aliases"), F.lower)
    first = (
        catalog.where("lat is not null and lon is not null")
        .select("ord", "name", "lat", "lon", F.explode(F.array_distinct(low)).alias("phrase"))
        .where("phrase <> ''")
        .groupBy("phrase")
        .agg(F.min(F.struct("ord", "name", "lat", "lon")).alias("n"))
    )
    heads = first.select(F.left("phrase", F.lit(CONTAINED_PREFIX)).alias("gram"), F.length("phrase").alias("size")).distinct()
    lengths = heads.agg(F.collect_set(F.length("gram")).alias("ns"))  # at most CONTAINED_PREFIX numbers
    lowered = criteria.select("query_id", F.lower("text").alias("low"))
    spots = (
        lowered.select("low").where("low <> ''").distinct().crossJoin(F.broadcast(lengths))
        .select("low", "ns", F.explode(F.expr("sequence(1, length(low))")).alias("i"))
        .select("low", "i", F.explode(F.expr("transform(ns, n -> substring(low, i, n))")).alias("gram"))
    )
    pieces = join_split(heads, spots, ["gram"], ["low"]).selectExpr("low", "substring(low, i, size) as phrase").distinct()
    found = pieces.join(first, "phrase").groupBy("low").agg(F.min("n").alias("n"))
    return lowered.join(found, "low").select("query_id", "n.*")


def origins(criteria: DataFrame, requested: DataFrame, complexes: DataFrame) -> DataFrame:
    """The requested complexes that are located; queries without any get every located one.

    ``criteria(query_id)``, ``requested(query_id, name)``, ``complexes(ord, name, aliases, lat,
    lon)``. Result ``(query_id, ord, fallback)``. The fallback is as large as both sides multiplied; arrays of both meet.
    """
    found = find_by_name(complexes, requested.select("name").distinct()).where("lat is not null and lon is not null")
    own = requested.join(found.select(F.col("asked").alias("name"), "ord"), "name").select("query_id", "ord").distinct()
    rest = criteria.select("query_id").join(own, "query_id", "left_anti")
    every = complexes.where("lat is not null and lon is not null").select("ord")
    return own.withColumn("fallback", F.lit(False)).unionByName(
        join_packed(rest, every, []).select("query_id", "ord").withColumn("fallback", F.lit(True))
    )
