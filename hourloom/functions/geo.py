"""Great-circle distance and its bounding box."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def distance_m(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Haversine distance in metres from a fixed point."""
    half_lat = F.sin(F.radians(lat - F.lit(lat0)) / 2)
    half_lon = F.sin(F.radians(lon - F.lit(lon0)) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bounding_box(lat: Column, lon: Column, lat0: float, lon0: float, radius_m: float) -> Column:
    """Range predicate that holds for every point within the radius; it reaches the Parquet scan.

    Longitude is left open near the poles and across the date line, where a simple range would
    lose points.
    """
    angle = radius_m / EARTH_RADIUS_M
    d_lat = math.degrees(angle) * 1.001
    box = lat.between(lat0 - d_lat, lat0 + d_lat)
    if abs(lat0) + d_lat < 89.0:
        d_lon = math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(lat0)))) * 1.001
        if -180.0 <= lon0 - d_lon and lon0 + d_lon <= 180.0:
            box = box & lon.between(lon0 - d_lon, lon0 + d_lon)
    return box
