"""Coercion, row and column filters, schema checks and missing-value reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions.numeric import share_missing, to_number
from hourloom.functions.timecols import to_instant
from hourloom.operators.ranks import consecutive_gaps, exact_quantiles


def coerce(
    df: DataFrame,
    timestamps: Sequence[str] = (),
    numbers: Sequence[str] = (),
    input_zone: str = "UTC",
) -> DataFrame:
    """Parse timestamp strings to UTC and numbers to double; bad values become NULL."""
    parsed = {c: to_instant(c, input_zone) for c in timestamps}
    parsed |= {c: to_number(c) for c in numbers}
    return df.withColumns(parsed)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows where every listed column is present."""
    return df.na.drop(how="any", subset=list(columns))


complete_cases = drop_missing


def with_required_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of a schema in order, adding absent ones as NULL."""
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Fail before any job runs when names, order or types differ."""
    have = [(f.name, f.dataType) for f in df.schema]
    want = [(f.name, f.dataType) for f in expected]
    if have != want:
        raise ValueError(f"schema mismatch: expected {want}, got {have}")
    return df


def pick_columns(
    df: DataFrame,
    pattern: str | None = None,
    prefix: str | None = None,
    exclude: Iterable[str] = (),
    where: Callable[[T.StructField], bool] | None = None,
) -> list[str]:
    """Column names by regular expression, prefix, exclusion or field predicate, resolved from the schema."""
    left_out = set(exclude)
    return [
        f.name
        for f in df.schema
        if f.name not in left_out
        and (pattern is None or re.search(pattern, f.name))
        and (prefix is None or f.name.startswith(prefix))
        and (where is None or where(f))
    ]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return pick_columns(df, exclude=exclude, where=lambda f: isinstance(f.dataType, T.NumericType))


def check_date_range(start: str, end: str) -> tuple[datetime, datetime]:
    """Validate a pair of ISO dates."""
    try:
        first, last = (datetime.combine(date.fromisoformat(d), datetime.min.time()) for d in (start, end))
    except ValueError as error:
        raise ValueError(f"invalid date: {error}") from error
    if last < first:
        raise ValueError(f"end {end} is before start {start}")
    return first, last


def between_dates(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows from the start date through the whole end date; the range reaches the Parquet scan."""
    check_date_range(start, end)
    after_end = f"TIMESTAMP_NTZ'{end} 00:00:00' + INTERVAL 1 DAY"
    return df.where(
        (F.col(ts) >= F.expr(f"TIMESTAMP_NTZ'{start} 00:00:00'")) & (F.col(ts) < F.expr(after_end))
    )


def missing_report(df: DataFrame, columns: Sequence[str], limit_pct: float = 50.0) -> DataFrame:
    """Missing count and rate per column in one pass, with a flag above the limit."""
    n = F.count(F.lit(1))
    cells = []
    for c in columns:
        missing = n - F.count(c)
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                missing.alias("n_missing"),
                share_missing(c).alias("pct_missing"),
            )
        )
    return (
        df.agg(F.array(*cells).alias("cells"))
        .select(F.inline("cells"))
        .withColumn("mostly_missing", F.coalesce(F.col("pct_missing") > limit_pct, F.lit(False)))
    )


def median_gap(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Exact median gap in hours between neighbouring timestamps of each key."""
    gaps = consecutive_gaps(df, keys, ts)
    medians = exact_quantiles(gaps, ["gap_us"], [0.5], keys=keys, weight="weight")
    return medians.select(
        *keys,
        (F.col("quantile") / 3.6e9).alias("median_hours"),
        F.col("n_values").alias("n_gaps"),
    )


def frequency_check(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", tolerance_s: float = 600.0
) -> DataFrame:
    """Is the median gap within the tolerance of one hour?"""
    off = F.abs(F.col("median_hours") * 3600.0 - 3600.0)
    return median_gap(df, keys, ts).withColumn("is_hourly", off <= tolerance_s)


def is_present(c: str) -> Column:
    return F.col(c).isNotNull()
