"""The shared tables seen as places, stations, listings and so on, in Spark and in SQL.

The coordinates are a formula of the key, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all tasks by ``key``, before costly texts are made of them.

    A file of one row group is read by one task, however many there are. Deal the bare keys, not the texts; the number
    is given, so that small rows are not merged again at run time.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def lat_of(key: Column) -> Column:
    return F.lit(55.40) + (key * 37 % 650) / F.lit(1000.0)


def lon_of(key: Column) -> Column:
    return F.lit(36.70) + (key * 53 % 1600) / F.lit(1000.0)


def sql_lat(key: str) -> str:
    return f"(55.40 + ({key} * 37 % 650) / 1000.0)::DOUBLE"


def sql_lon(key: str) -> str:
    return f"(36.70 + ({key} * 53 % 1600) / 1000.0)::DOUBLE"


def sql_hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(sin(radians({lat2}-{lat1})/2.0)*sin(radians({lat2}-{lat1})/2.0)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*sin(radians({lon2}-{lon1})/2.0)*sin(radians({lon2}-{lon1})/2.0))"
    )
    return f"(12742000.0*atan2(sqrt({a}),sqrt(greatest(1.0-{a},0.0))))"


# --- places: suppliers; every 23rd has no coordinates ---------------------------------------


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Complexes: one per supplier, tagged with nation, region and a station name."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    p = table(spark, sf, "part")
    key = F.col("s_suppkey")
    located = key % 23 != 7
    station = p.select(
        F.col("p_partkey").alias("s_suppkey"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("metro"),
    )
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(station, "s_suppkey", "left")
        .select(
            key.alias("ord"),
            F.concat(F.lit("b"), key.cast("string")).alias("place_id"),
            F.concat(F.lit("c"), key.cast("string")).alias("slug"),
            F.col("s_name").alias("name"),
            F.when(located, lat_of(key)).alias("lat"),
            F.when(located, lon_of(key)).alias("lon"),
            F.col("n_name").alias("district"),
            F.col("r_name").alias("county"),
            "metro",
        )
    )


SQL_PLACES = f"""places AS (
  SELECT s_suppkey AS ord, 'b' || s_suppkey AS place_id, 'c' || s_suppkey AS slug, s_name AS name,
         CASE WHEN s_suppkey % 23 <> 7 THEN {sql_lat('s_suppkey')} END AS lat,
         CASE WHEN s_suppkey % 23 <> 7 THEN {sql_lon('s_suppkey')} END AS lon,
         n_name AS district, r_name AS county, p_name || ' ' || p_size AS metro
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON p_partkey = s_suppkey)"""


# --- points: customers ----------------------------------------------------------------------


def points(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("point_id"), lat_of(key).alias("lat"), lon_of(key).alias("lon")
    )


SQL_POINTS = f"""points AS (
  SELECT c_custkey AS point_id, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon
  FROM customer)"""


# --- stations: parts; every 29th has no coordinates -----------------------------------------


def stations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    located = key % 29 != 3
    return table(spark, sf, "part").select(
        key.alias("ord"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"),
        F.concat_ws(" / ", "p_brand", "p_type").alias("line"),
        F.when(located, lat_of(key)).alias("lat"),
        F.when(located, lon_of(key)).alias("lon"),
    )


SQL_STATIONS = f"""stations AS (
  SELECT p_partkey AS ord, p_name || ' ' || p_size AS name, p_brand || ' / ' || p_type AS line,
         CASE WHEN p_partkey % 29 <> 3 THEN {sql_lat('p_partkey')} END AS lat,
         CASE WHEN p_partkey % 29 <> 3 THEN {sql_lon('p_partkey')} END AS lon
  FROM part)"""

# Matching key in SQL, for the ASCII letters of the shared tables plus the folded ones.
def sql_key(expr: str) -> str:
    return (
        "trim(regexp_replace(translate(replace(lower(" + expr + "),'ß','ss'),"
        "'ёabcehkmoptxy','еавсенкмортху'),'\\s+',' ','g'))"
    )


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
