"""Column helpers for distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6371000.0
CENTRE_LAT = 55.75222
CENTRE_LON = 37.61556
CENTRE_RADIUS_M = 5000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    sin_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    sin_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lon * sin_lon
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1.0 - a, F.lit(0.0))))


def is_center(lat: Column, lon: Column, radius_m: float = CENTRE_RADIUS_M) -> Column:
    """Within ``radius_m`` of the fixed centre."""
    return haversine_m(F.lit(CENTRE_LAT), F.lit(CENTRE_LON), lat, lon) <= radius_m


def to_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the sphere in metres, shifted so that every coordinate is >= 0."""
    phi, lam = F.radians(lat), F.radians(lon)
    r = F.lit(EARTH_RADIUS_M)
    return (
        r * F.cos(phi) * F.cos(lam) + r,
        r * F.cos(phi) * F.sin(lam) + r,
        r * F.sin(phi) + r,
    )
