"""Declarative feature sets over a complete hourly wide table.

A feature set is a list of Feature entries that carry their own group, so ablations pick columns by
group and not by name. add_features turns the list into one projection over one bucketed window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.meteo import calm_flag, inversion_flag, wind_vector
from hourloom.functions.numeric import flag
from hourloom.functions.timecols import calendar_columns, cyclical, from_hour_index, in_months, local_time
from hourloom.operators.grid import HOUR
from hourloom.operators.windows import Feature, add_features, difference, lag, lead, local, of_lag, rolling
from hourloom.settings import (
    HEATING_MONTHS,
    HORIZONS,
    STATION_LAGS,
    TARGET_LAGS,
    WEATHER_LAGS,
    WINTER_MONTHS,
)

ABLATION_ORDER = ["lag", "roll", "time", "reanalysis", "station"]


def wall_clock(zone: str | None) -> Column:
    """Wall clock of the row's hour: UTC, or local time in a zone."""
    utc = from_hour_index(HOUR)
    return local_time(utc, zone) if zone else utc


def add_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, Monday-0 weekday, month, year, date and ISO week."""
    return df.withColumns(calendar_columns(ts))


def _cycle(name: str, value: Callable[[], Column], period: int) -> list[Feature]:
    return [
        local(f"{name}_sin", lambda: cyclical(value(), period)[0]),
        local(f"{name}_cos", lambda: cyclical(value(), period)[1]),
    ]


def _clock(zone: str | None, part: Callable[[Column], Column]) -> Callable[[], Column]:
    return lambda: part(wall_clock(zone))


def exogenous_block(other: str, lags: Sequence[int], window: int = 24, min_count: int = 12) -> list[Feature]:
    """Lags and a rolling mean of a companion series."""
    block = [lag(f"{other}_lag_{k}", other, k, "exogenous") for k in lags]
    block.append(rolling(f"{other}_roll_mean_{window}", other, "mean", window, min_count, group="exogenous"))
    return block


def next_hour_features(
    target: str, companion: str | None = None, companion_lags: Sequence[int] = (1, 24), zone: str | None = None
) -> list[Feature]:
    """The one-hour-ahead feature set: calendar, lags, rolling statistics, changes, companion series."""
    hour, month = _clock(zone, F.hour), _clock(zone, F.month)
    features = [
        local("hour", hour),
        local("day_of_week", _clock(zone, F.weekday)),
        local("month", month),
        local("year", _clock(zone, F.year)),
        local("day_of_year", _clock(zone, F.dayofyear)),
        *_cycle("hour", hour, 24),
        *_cycle("month", month, 12),
    ]
    features += [lag(f"{target}_lag_{k}", target, k) for k in TARGET_LAGS]
    for how in ("mean", "std", "min", "max"):
        features.append(rolling(f"{target}_roll_{how}_24", target, how, 24, 12))
    for how in ("mean", "std"):
        features.append(rolling(f"{target}_roll_{how}_168", target, how, 168, 84))
    features += [difference(f"{target}_diff_{k}", target, k, lagged=False) for k in (1, 24)]
    if companion:
        features += exogenous_block(companion, companion_lags)
    return features


def multi_source_features(target: str, columns: Sequence[str], zone: str | None = None) -> list[Feature]:
    """The multi-source feature set; blocks adapt to the columns the wide table has."""
    have = set(columns)
    features = [lag(f"{target}_lag_{k}", target, k) for k in TARGET_LAGS]
    for window in (6, 24, 168):
        for how in ("mean", "std", "max"):
            features.append(rolling(f"{target}_roll_{how}_{window}", target, how, window))
    features += [difference(f"{target}_diff_{k}", target, k, lagged=True) for k in (1, 24)]
    features += _cycle("hour", _clock(zone, F.hour), 24)
    features += _cycle("month", _clock(zone, F.month), 12)
    features += _cycle("dow", _clock(zone, F.weekday), 7)
    features.append(local("day_of_year", _clock(zone, F.dayofyear)))
    features.append(local("heating_season", _clock(zone, lambda t: flag(in_months(t, HEATING_MONTHS)))))
    features.append(local("is_winter", _clock(zone, lambda t: flag(in_months(t, WINTER_MONTHS)))))
    features += reanalysis_features(have, zone)
    features += station_features(sorted(c for c in columns if c.startswith("ms_")), have)
    return features


def reanalysis_features(have: set[str], zone: str | None = None) -> list[Feature]:
    group = "reanalysis"
    out: list[Feature] = []
    if {"wind_spd", "wind_dir"} <= have:
        for i, name in enumerate(("wind_u", "wind_v")):
            out.append(local(name, lambda i=i: wind_vector(F.col("wind_spd"), F.col("wind_dir"))[i], group))
    for k in WEATHER_LAGS:
        out += [lag(f"{c}_lag_{k}", c, k, group) for c in ("temp", "wind_spd", "humidity") if c in have]
    for window in (6, 24):
        for c in ("temp", "wind_spd", "humidity", "blh"):
            if c in have:
                out += [
                    rolling(f"{c}_roll_{how}_{window}", c, how, window, group=group) for how in ("mean", "std")
                ]
    if "blh" in have:
        out.append(of_lag("blh_log", ["blh"], F.log1p, group))
        out += [lag(f"blh_lag_{k}", "blh", k, group) for k in (1, 24)]
    if {"temp", "wind_spd"} <= have:
        out.append(
            of_lag("inversion_flag", ["temp", "wind_spd"], lambda t, w: inversion_flag(t, w, wall_clock(zone)), group)
        )
        out.append(of_lag("temp_x_wind", ["temp", "wind_spd"], lambda t, w: t * w, group))
    if "wind_spd" in have:
        out.append(of_lag("calm_flag", ["wind_spd"], calm_flag, group))
    if "precip" in have:
        out += [lag(f"precip_lag_{k}", "precip", k, group) for k in (1, 6)]
    out += [lag(f"{c}_lag_1", c, 1, group) for c in ("no2", "aod", "dust") if c in have]
    return out


def station_features(station_columns: Sequence[str], have: set[str]) -> list[Feature]:
    group = "station"
    out: list[Feature] = []
    for c in station_columns:
        out += [lag(f"{c}_lag_{k}", c, k, group) for k in STATION_LAGS]
        out.append(rolling(f"{c}_roll_mean_24", c, "mean", 24, group=group))
    for name, ours, theirs in (("temp_bias", "temp", "ms_temp"), ("wind_bias", "wind_spd", "ms_wind_spd")):
        if {ours, theirs} <= have:
            out.append(of_lag(name, [ours, theirs], lambda a, b: a - b, group))
    return out


def horizon_targets(target: str, horizons: Sequence[int] = tuple(HORIZONS)) -> list[Feature]:
    return [lead(f"target_{h}h", target, h) for h in horizons]


def names_of(features: Sequence[Feature], groups: Sequence[str] | None = None) -> list[str]:
    return [f.name for f in features if f.group != "target" and (groups is None or f.group in groups)]


def by_group(features: Sequence[Feature]) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for f in features:
        groups.setdefault(f.group, []).append(f.name)
    return groups


def ablation_sets(features: Sequence[Feature]) -> list[tuple[str, list[str]]]:
    """Cumulative column sets: the first lag alone, then one more group at a time."""
    groups = by_group(features)
    lags = groups.get("lag", [])
    sets = [("lag_1 only", lags[:1])]
    columns: list[str] = []
    for g in ABLATION_ORDER:
        columns = columns + groups.get(g, [])
        sets.append((f"+ {g}", columns))
    return [(label, cols) for label, cols in sets if cols]


def feature_table(
    grid: DataFrame,
    features: Sequence[Feature],
    keys: Sequence[str] = (),
    keep: Sequence[str] = (),
    required: Sequence[str] = (),
    bucket_hours: int | None = None,
) -> DataFrame:
    """Key, hour and features of a grid; rows without the required columns are dropped."""
    options = {} if bucket_hours is None else {"bucket_hours": bucket_hours}
    table = add_features(grid, features, keys, keep=[*keys, HOUR, *keep], **options)
    return table.na.drop(subset=list(required)) if required else table


def long_targets(table: DataFrame, horizons: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """Unpivot horizon targets to (horizon, y) rows."""
    cells = [F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}h").alias("y")) for h in horizons]
    return table.select(*keep, F.inline(F.array(*cells))).where(F.col("y").isNotNull())
