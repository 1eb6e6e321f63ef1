"""Lags, rolling statistics, differences and lead targets over complete hourly grids.

A single long series has no natural partition key: a window over it would run as one task. The
functions here cut every series into time buckets and copy a halo of neighbouring rows into each
bucket, so that windows partition by (series, bucket). Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.functions.numeric import at_least
from hourloom.functions.timecols import floor_div
from hourloom.operators.grid import HOUR

DEFAULT_BUCKET_HOURS = 24 * 90

AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
}


@dataclass(frozen=True)
class Feature:
    """A named column over an hourly series, with how far it looks back and ahead in hours."""

    name: str
    build: Callable[[WindowSpec], Column]
    back: int = 0
    ahead: int = 0
    group: str = ""


def lag(name: str, source: str, hours: int, group: str = "lag") -> Feature:
    return Feature(name, lambda w: F.lag(source, hours).over(w), back=hours, group=group)


def lead(name: str, source: str, hours: int, group: str = "target") -> Feature:
    return Feature(name, lambda w: F.lead(source, hours).over(w), ahead=hours, group=group)


def rolling(
    name: str,
    source: str,
    how: str,
    hours: int,
    min_count: int | None = None,
    lagged: bool = True,
    group: str = "roll",
) -> Feature:
    """Trailing statistic, NULL where fewer than min_count values are present.

    lagged=True ends the frame one row back, so the current value never enters its own feature.
    """
    minimum = hours if min_count is None else min_count
    last = -1 if lagged else 0
    first = last - hours + 1

    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(first, last)
        return at_least(F.count(source).over(frame), minimum, AGGREGATES[how](source).over(frame))

    return Feature(name, build, back=-first, group=group)


def difference(name: str, source: str, hours: int, lagged: bool, group: str = "roll") -> Feature:
    """v[t] - v[t-k], or one hour earlier on both ends when lagged."""
    if lagged:
        return Feature(
            name,
            lambda w: F.lag(source, 1).over(w) - F.lag(source, hours + 1).over(w),
            back=hours + 1,
            group=group,
        )
    return Feature(
        name, lambda w: F.col(source) - F.lag(source, hours).over(w), back=hours, group=group
    )


def local(name: str, expression: Callable[[], Column], group: str = "time") -> Feature:
    """A feature of the current row only. The expression is built on use, so sets need no session."""
    return Feature(name, lambda w: expression(), group=group)


def of_lag(
    name: str, sources: Sequence[str], combine: Callable[..., Column], group: str, hours: int = 1
) -> Feature:
    """Combine values taken from the same earlier row."""
    return Feature(
        name,
        lambda w: combine(*[F.lag(s, hours).over(w) for s in sources]),
        back=hours,
        group=group,
    )


def add_features(
    grid: DataFrame,
    features: Sequence[Feature],
    keys: Sequence[str] = (),
    bucket_hours: int | None = DEFAULT_BUCKET_HOURS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append features to a complete hourly grid in one window pass.

    keep names the grid columns to carry (all of them by default). bucket_hours=None falls back to
    one window per series and therefore needs keys.
    """
    kept = list(keep if keep is not None else grid.columns)
    if bucket_hours is None:
        if not keys:
            raise ValueError("a grid without series keys needs bucket_hours")
        window = W.partitionBy(*keys).orderBy(HOUR)
        return grid.select(*kept, *[f.build(window).alias(f.name) for f in features])

    back = max((f.back for f in features), default=0)
    ahead = max((f.ahead for f in features), default=0)
    size = max(bucket_hours, back, ahead, 1)
    own = floor_div(F.col(HOUR), size)
    offset = F.pmod(F.col(HOUR), F.lit(size).cast("bigint"))
    homes = [own]
    if back:
        homes.append(F.when(offset >= size - back, own + 1))
    if ahead:
        homes.append(F.when(offset < ahead, own - 1))
    # the explicit exchange keeps buckets apart even when the input happens to be clustered by key
    spread = grid.withColumns(
        {"_own": own, "_bucket": F.explode(F.array_compact(F.array(*homes)))}
    ).repartition(*keys, "_bucket")
    window = W.partitionBy(*keys, "_bucket").orderBy(HOUR)
    columns = [f.build(window).alias(f.name) for f in features]
    return (
        spread.select(*kept, "_own", "_bucket", *columns)
        .where(F.col("_bucket") == F.col("_own"))
        .drop("_own", "_bucket")
    )
