"""Station feeds: renames, unit conversion, radius filter and station choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions.geo import bounding_box, distance_m
from hourloom.functions.meteo import kmh_to_ms
from hourloom.settings import STATION_COLUMNS, STATION_KMH_COLUMNS


def standardise_station(feed: DataFrame, keep: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Rename feed variables, convert wind speeds from km/h to m/s and keep the station columns."""
    renamed = feed.withColumnsRenamed({k: v for k, v in STATION_COLUMNS.items() if k in feed.columns})
    wanted = [c for c in renamed.columns if c.startswith("ms_")]
    return renamed.select(
        *keep,
        *[(kmh_to_ms(F.col(c)) if c in STATION_KMH_COLUMNS else F.col(c)).alias(c) for c in wanted],
    )


def within_radius(
    df: DataFrame, lat0: float, lon0: float, radius_m: float, lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Rows within a radius: a range prefilter for the scan, then the exact distance."""
    a, b = F.col(lat), F.col(lon)
    boxed = df.where(bounding_box(a, b, lat0, lon0, radius_m))
    return boxed.withColumn("distance_m", distance_m(a, b, lat0, lon0)).where(
        F.col("distance_m") <= radius_m
    )


def pick_station(
    stations: DataFrame,
    station_id: int | str | None,
    lat0: float,
    lon0: float,
    id_col: str = "station_id",
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """The station with the given id, or else the nearest one; ties go to the smallest id."""
    distance = distance_m(F.col(lat), F.col(lon), lat0, lon0)
    miss = F.lit(1) if station_id is None else F.when(F.col(id_col) == F.lit(station_id), 0).otherwise(1)
    return (
        stations.withColumns({"distance_m": distance, "_miss": miss})
        .orderBy("_miss", "distance_m", id_col)
        .limit(1)
        .drop("_miss")
    )
