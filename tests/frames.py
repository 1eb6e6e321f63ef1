"""Small frames the tests share."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

EPOCH = dt.datetime(1970, 1, 1)


def hour_of(ts: dt.datetime) -> int:
    return int((ts - EPOCH).total_seconds() // 3600)


def gappy_hours(spark):
    """Two series over 60 hours with missing hours and null values, in shuffled order."""
    rng = np.random.default_rng(7)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for name in ("a", "b"):
        for i in range(60):
            if i % 11 == 3 and 0 < i < 59:
                continue
            value = None if i % 7 == 5 else float(np.round(rng.normal(20, 5), 2))
            rows.append((name, start + dt.timedelta(hours=i, minutes=int(rng.integers(0, 60))), value))
    rng.shuffle(rows)
    rows = [(n, t, None if v is None else float(v)) for n, t, v in rows]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")


def grid_frame(spark, n: int, series: tuple[str, ...] = ("s",), null_every: int = 13, seed: int = 3):
    """Complete hourly grids with nulls, as (Spark frame, pandas frame)."""
    rng = np.random.default_rng(seed)
    first = hour_of(dt.datetime(2024, 1, 1))
    parts = []
    for name in series:
        value = np.round(rng.normal(30, 10, n), 2)
        value[::null_every] = np.nan
        parts.append(pd.DataFrame({"series": name, "hour_index": np.arange(first, first + n), "value": value}))
    pdf = pd.concat(parts, ignore_index=True)
    rows = [
        (s, int(h), None if np.isnan(v) else float(v))
        for s, h, v in pdf.sample(frac=1.0, random_state=1).itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "series string, hour_index bigint, value double"), pdf


def ar_daily(spark, n: int = 1500, seed: int = 11):
    """AR(1) noise around a daily cycle, with a companion series and weather."""
    rng = np.random.default_rng(seed)
    first = hour_of(dt.datetime(2024, 1, 1))
    noise, level = np.zeros(n), 0.0
    for i in range(n):
        level = 0.7 * level + rng.normal(0, 2)
        noise[i] = level
    cycle = 12 * np.sin(2 * np.pi * np.arange(n) / 24)
    pm25 = 40 + cycle + noise
    frame = pd.DataFrame(
        {
            "hour_index": np.arange(first, first + n),
            "pm25": pm25,
            "pm10": pm25 * 1.5 + rng.normal(0, 1, n),
            "temp": rng.normal(0, 8, n),
            "wind_spd": rng.uniform(0, 5, n),
            "wind_dir": rng.uniform(0, 360, n),
            "humidity": rng.uniform(20, 90, n),
            "blh": rng.uniform(50, 900, n),
        }
    )
    return spark.createDataFrame(frame)


def rows_by(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def close(a, b, tolerance=1e-9):
    if a is None or b is None:
        return (a is None or np.isnan(a)) and (b is None or np.isnan(b))
    if np.isnan(a) or np.isnan(b):
        return np.isnan(a) and np.isnan(b)
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
