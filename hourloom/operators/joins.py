"""Joins of hourly series on their key and instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hourloom.operators.grid import HOUR, resample_hourly


def join_series(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), on: str = HOUR) -> DataFrame:
    """Inner equi-join. Both sides hold one row per key and hour, so no key can dominate a task."""
    return left.join(right, [*keys, on], "inner")


def attach_station(
    grid: DataFrame,
    station: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    ts: str = "ts",
    scale: int | None = None,
) -> DataFrame:
    """Left join of a sparse station feed, brought to UTC and hourly means first.

    Resampling before the join keeps it one-to-one, however often a station reports.
    """
    hourly = resample_hourly(station, columns, keys, ts=ts, scale=scale)
    return grid.join(hourly, [*keys, HOUR], "left")
