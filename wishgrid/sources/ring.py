"""Polygon rings as edge tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "ring_id string, lat1 double, lon1 double, lat2 double, lon2 double"


def ring_edges(rings: DataFrame) -> DataFrame:
    """``(ring_id, ring array<array<double>> of [lon, lat])`` -> edges, the last one closing.

    Each edge is built from two neighbours of the same array, so no shuffle is needed.
    """
    shifted = F.concat(
        F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", F.lit(1), F.lit(1))
    )
    return rings.select("ring_id", F.explode(F.arrays_zip("ring", shifted)).alias("e")).select(
        "ring_id",
        F.col("e")["ring"][1].alias("lat1"),
        F.col("e")["ring"][0].alias("lon1"),
        F.col("e")["1"][1].alias("lat2"),
        F.col("e")["1"][0].alias("lon2"),
    )


def read_polygon(spark: SparkSession, path: str, ring_id: str = "ring") -> DataFrame:
    """A JSON document ``{"ring_lonlat": [[lon, lat], …]}`` -> edges."""
    docs = (
        spark.read.schema("ring_lonlat array<array<double>>")
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
    )
    return ring_edges(docs.select(F.lit(ring_id).alias("ring_id"), F.col("ring_lonlat").alias("ring")))


def edges_of_vertices(vertices: DataFrame) -> DataFrame:
    """Edges of rings given as vertex rows ``(ring_id, pos, lat, lon)``.

    The next vertex is found by an equi-join on the position, not by gathering a ring.
    """
    last = vertices.groupBy("ring_id").agg(F.max("pos").alias("last_pos"))
    nxt = vertices.join(last, "ring_id").select(
        "ring_id",
        F.when(F.col("pos") == 0, F.col("last_pos")).otherwise(F.col("pos") - 1).alias("pos"),
        F.col("lat").alias("lat2"),
        F.col("lon").alias("lon2"),
    )
    return vertices.join(nxt, ["ring_id", "pos"]).select(
        "ring_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat2", "lon2"
    )


def sample_ring(vertices: int = 48) -> list[tuple[float, float]]:
    """A closed ellipse around the middle of the formula coordinates, as ``(lon, lat)``."""
    return [
        (
            round(37.5 + 0.5 * math.cos(2 * math.pi * i / vertices), 6),
            round(55.725 + 0.2 * math.sin(2 * math.pi * i / vertices), 6),
        )
        for i in range(vertices)
    ]


def edges_of_ring(spark: SparkSession, ring: list[tuple[float, float]]) -> DataFrame:
    rows = [("ring", [list(v) for v in ring])]
    return ring_edges(spark.createDataFrame(rows, "ring_id string, ring array<array<double>>"))
