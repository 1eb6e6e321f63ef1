"""Long to wide pivots, hourly resampling and the complete hourly grid.

Every step aggregates with map-side combine first, so a parameter, station or hour that holds a
large share of the rows is reduced before it crosses the network. Only hourly results are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions.numeric import mean
from hourloom.functions.timecols import from_hour_index, hour_index

HOUR = "hour_index"


def pivot_mean(
    df: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    name_col: str = "parameter",
    value_col: str = "value",
    scale: int | None = None,
) -> DataFrame:
    """Mean per key with one column per name; names without data give NULL columns.

    Conditional aggregates need one shuffle on the keys, where a generic pivot needs two.
    """
    wanted = df.where(F.col(name_col).isin(list(names)))
    cells = [
        mean(F.when(F.col(name_col) == n, F.col(value_col)), scale).alias(n) for n in names
    ]
    return wanted.groupBy(*keys).agg(*cells)


def resample_hourly(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    ts: str = "ts",
    scale: int | None = None,
) -> DataFrame:
    """Hourly means per key; the hour is kept as an integer index since the epoch."""
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, hour_index(ts).alias(HOUR))
        .agg(*[mean(c, scale).alias(c) for c in columns])
    )


def hour_span(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """First and last hour per key, straight from the raw rows: a narrow scan and a tiny shuffle."""
    return df.groupBy(*keys).agg(
        hour_index(F.min(ts)).alias("first_hour"), hour_index(F.max(ts)).alias("last_hour")
    )


def hourly_grid(span: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every hour between the first and the last hour of each key."""
    return span.where(F.col("first_hour").isNotNull()).select(
        *keys, F.explode(F.sequence("first_hour", "last_hour")).alias(HOUR)
    )


def regularise(
    hourly: DataFrame, keys: Sequence[str] = (), span: DataFrame | None = None
) -> DataFrame:
    """Left join onto the complete grid, so that one row back is always one hour back.

    Pass span = hour_span(raw rows) to keep the bounds on a column-pruned scan of the source
    instead of repeating the aggregation.
    """
    if span is None:
        span = hourly.groupBy(*keys).agg(
            F.min(HOUR).alias("first_hour"), F.max(HOUR).alias("last_hour")
        )
    return hourly_grid(span, keys).join(hourly, [*keys, HOUR], "left")


def with_timestamp(df: DataFrame, name: str = "ts") -> DataFrame:
    return df.withColumn(name, from_hour_index(HOUR))


def hourly_wide(
    measurements: DataFrame,
    names: Sequence[str],
    keys: Sequence[str] = (),
    value_scale: int | None = None,
    mean_scale: int | None = None,
) -> DataFrame:
    """Long measurements to a complete hourly wide table.

    An hour is the mean of its per-timestamp means, so a timestamp reported by many stations weighs
    as much as one reported once. Give the station among the keys to keep stations apart.
    """
    wanted = measurements.where(F.col("parameter").isin(list(names)) & F.col("ts").isNotNull())
    per_instant = pivot_mean(wanted, [*keys, "ts"], names, scale=value_scale)
    hourly = resample_hourly(per_instant, names, keys, scale=mean_scale)
    return regularise(hourly, keys, hour_span(wanted, keys))


def hourly_long(
    measurements: DataFrame,
    keys: Sequence[str] = ("parameter",),
    value_scale: int | None = None,
    mean_scale: int | None = None,
) -> DataFrame:
    """The same in long form: one complete hourly series per key."""
    present = measurements.where(F.col("ts").isNotNull())
    per_instant = present.groupBy(*keys, "ts").agg(mean("value", value_scale).alias("value"))
    hourly = resample_hourly(per_instant, ["value"], keys, scale=mean_scale)
    return regularise(hourly, keys, hour_span(present, keys))


def dense_profile(
    cells: DataFrame, axes: dict[str, Sequence[int]], keys: Sequence[str] = ()
) -> DataFrame:
    """Left join a profile onto every combination of its small axes, keeping empty cells as NULL.

    The combinations come from array literals of fixed length, not from a cross join.
    """
    frame = cells.select(*keys).distinct() if keys else cells.sparkSession.range(1).select()
    for name, values in axes.items():
        axis = F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
        frame = frame.select("*", axis)
    return frame.join(cells, [*keys, *axes], "left")
