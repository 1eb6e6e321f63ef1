"""Numeric expressions: coercion, reproducible means, flags, error terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(value: Column | str) -> Column:
    """Numeric coercion: anything unparseable, and NaN, becomes NULL."""
    number = _col(value).try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number)


def mean(value: Column | str, scale: int | None = None) -> Column:
    """Mean over non-null values.

    Doubles are summed in whatever order partitions arrive, so the last digits of a plain mean
    depend on the cluster. With a scale, values are summed as fixed-point decimals: exact and the
    same on any partitioning. Use it when the readings have a known number of decimals.
    """
    value = _col(value)
    if scale is None:
        return F.avg(value)
    total = F.sum(value.cast(f"decimal(24,{scale})")).cast("double")
    return total / F.nullif(F.count(value), F.lit(0)).cast("double")


def flag(condition: Column) -> Column:
    """1.0 / 0.0 flag where an unknown condition counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def share_missing(value: Column | str) -> Column:
    """Percentage of NULLs."""
    return F.lit(100.0) * F.avg(_col(value).isNull().cast("double"))


def share_present(value: Column | str) -> Column:
    return F.lit(100.0) * F.avg(_col(value).isNotNull().cast("double"))


def at_least(count: Column, minimum: int, result: Column) -> Column:
    return F.when(count >= F.lit(minimum), result)
