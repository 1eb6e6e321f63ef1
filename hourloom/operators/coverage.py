"""Availability of landed sources: station counts, parameter presence, preferred source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probe_last_days(df: DataFrame, days: int = 7, ts: str = "ts") -> DataFrame:
    """Rows of the last days; the bound is a one-value subquery, evaluated before the scan."""
    return df.where(F.col(ts) >= df.agg(F.max(ts)).scalar() - F.expr(f"INTERVAL '{days}' DAY"))


def probe_first_days(df: DataFrame, days: int = 7, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) <= df.agg(F.min(ts)).scalar() + F.expr(f"INTERVAL '{days}' DAY"))


def parameter_coverage(
    df: DataFrame, location: str = "location", parameter: str = "parameter", value: str = "value"
) -> DataFrame:
    """Rows, non-null values and distinct locations per parameter.

    Rows are reduced per (parameter, location) first, so a parameter with most of the rows is
    spread over its locations.
    """
    per_location = df.groupBy(parameter, location).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_valid")
    )
    return per_location.groupBy(parameter).agg(
        F.sum("_rows").alias("n_rows"),
        F.sum("_valid").alias("n_valid"),
        F.count(location).alias("n_locations"),
    )


def station_names(df: DataFrame, location: str = "location") -> DataFrame:
    """Distinct stations as rows rather than one collected list."""
    return df.select(location).distinct()


def source_coverage(
    stations: DataFrame, modelled: DataFrame, parameters: Sequence[str], location: str = "location"
) -> DataFrame:
    """One row comparing a station source (long) with a modelled source (wide).

    Stations win whenever they report any of the parameters, the modelled source is the fallback.
    """
    presence = [
        F.coalesce(F.bool_or((F.col("parameter") == p) & F.col("value").isNotNull()), F.lit(False)).alias(
            f"{p}_in_stations"
        )
        for p in parameters
    ]
    per_location = stations.groupBy(location).agg(*presence)
    found = per_location.agg(
        F.count(location).alias("station_count"),
        *[
            F.coalesce(F.bool_or(f"{p}_in_stations"), F.lit(False)).alias(f"{p}_in_stations")
            for p in parameters
        ],
    )
    hours = modelled.agg(
        F.struct(
            F.count(F.lit(1)).alias("modelled_rows"),
            *[F.count(p).alias(f"{p}_modelled_valid") for p in parameters],
        )
    ).scalar()
    any_station = F.lit(False)
    for p in parameters:
        any_station = any_station | F.col(f"{p}_in_stations")
    has_station = (F.col("station_count") > 0) & any_station
    return (
        found.withColumn("_m", hours)
        .select("*", "_m.*")
        .drop("_m")
        .withColumn(
            "recommended_source",
            F.when(has_station, "stations").when(F.col("modelled_rows") > 0, "modelled"),
        )
    )
