"""The three end-to-end runs: land an hourly table, build feature tables, score all horizons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators.clean import assert_schema
from hourloom.operators.grid import hourly_wide, regularise, resample_hourly, with_timestamp
from hourloom.operators.joins import attach_station, join_series
from hourloom.operators.windows import Feature
from hourloom.plans.features import feature_table, horizon_targets, multi_source_features, names_of
from hourloom.plans.models import Regressor, horizon_experiments, horizon_models
from hourloom.settings import (
    CENTRE_LATITUDE,
    CENTRE_LONGITUDE,
    HORIZONS,
    LOCAL_ZONE,
    SEARCH_RADIUS_M,
    WIDE_POLLUTION_SCHEMA,
)
from hourloom.sources.files import dataset_manifest, read_parquet, write_manifest, write_parquet
from hourloom.sources.payloads import read_measurements
from hourloom.sources.stations import within_radius

TOGETHER = 8  # tables of one target and horizon held at once


def land_pollution(
    spark: SparkSession,
    folder: str,
    table: str,
    manifest: str,
    start: str | None = None,
    end: str | None = None,
    centre: tuple[float, float] | None = (CENTRE_LATITUDE, CENTRE_LONGITUDE),
    radius_m: float = SEARCH_RADIUS_M,
) -> DataFrame:
    """Measurement payloads near a point to a checked hourly Parquet table with a manifest beside it."""
    rows = read_measurements(spark, folder, start, end)
    if centre is not None:
        rows = within_radius(rows, *centre, radius_m)
    names = [f.name for f in WIDE_POLLUTION_SCHEMA if f.name != "ts"]
    hourly = with_timestamp(hourly_wide(rows, names)).select("ts", *names)
    write_parquet(assert_schema(hourly, WIDE_POLLUTION_SCHEMA), table, ts="ts")
    landed = read_parquet(spark, table, ["ts", *names])
    write_manifest(
        dataset_manifest(landed, names, extra={"zone": "UTC", "method": "hourly mean", "output": table}), manifest
    )
    return landed


def join_sources(air: DataFrame, weather: DataFrame, station: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Air quality with weather on common hours, station readings where present, all hours filled in."""

    def values(df: DataFrame) -> list[str]:
        return [c for c in df.columns if c != ts]

    joined = join_series(resample_hourly(air, values(air), ts=ts), resample_hourly(weather, values(weather), ts=ts))
    if station is not None:
        columns = [c for c in station.columns if c.startswith("ms_")]
        joined = attach_station(joined, station, columns, ts=ts)
    return regularise(joined)


def build_features(
    grid: DataFrame, target: str, zone: str | None = LOCAL_ZONE, horizons: Sequence[int] = tuple(HORIZONS)
) -> tuple[DataFrame, list[Feature]]:
    """The multi-source feature table of one target; rows without the shortest horizon are dropped."""
    features = multi_source_features(target, grid.columns, zone)
    targets = horizon_targets(target, horizons)
    return feature_table(grid, [*features, *targets], required=[targets[0].name]), features


def score_horizons(
    tables: dict[str, tuple[DataFrame, list[Feature]]],
    horizons: Sequence[int] = tuple(HORIZONS),
    regressors: Sequence[Regressor] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Metrics of every target, horizon and model, and the model comparison tests.

    All targets and horizons are run together, up to TOGETHER of them; more come in turns.
    """
    regressors = list(regressors or horizon_models())
    held = {target: table.persist(StorageLevel.MEMORY_AND_DISK) for target, (table, _) in tables.items()}
    asked = [
        ((target, h), held[target], names_of(features), f"target_{h}h", f"{target}_lag_1")
        for target, (_, features) in tables.items()
        for h in horizons
    ]
    metrics, tests = [], []
    for first in range(0, len(asked), TOGETHER):
        for (target, h), run in horizon_experiments(asked[first : first + TOGETHER], regressors).items():
            labels = [F.lit(target).alias("pollutant"), F.lit(f"{h}h").alias("horizon")]
            metrics.append(run.metrics.select(*labels, "*"))
            if run.comparison is not None:
                tests.append(run.comparison.select(*labels, "n", "stat", "p_value", "significant"))
    for table in held.values():
        table.unpersist()
    return reduce(DataFrame.unionByName, metrics), reduce(DataFrame.unionByName, tests) if tests else None

