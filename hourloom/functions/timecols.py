"""Time expressions.

Instants are kept as TIMESTAMP_NTZ holding UTC wall clock: ordering, joining and lagging happen on
that column, and local wall clock is derived only for calendar features. None of the expressions
depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourloom.settings import MONTH_LABELS, WEEKDAY_LABELS

MINUTE_US = 60_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def floor_div(value: Column, step: int) -> Column:
    """Integer floor division, correct for negative values too."""
    width = F.lit(step).cast("bigint")
    return F.call_function("div", value - F.pmod(value, width), width)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch from date and clock parts, which need no zone."""
    ts = _col(ts)
    minutes = F.unix_date(F.to_date(ts)).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def hour_index(ts: Column | str) -> Column:
    """Whole hours since the epoch; consecutive hours differ by one."""
    ts = _col(ts)
    return F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)


def from_hour_index(index: Column | str) -> Column:
    return F.timestamp_add("HOUR", _col(index), epoch())


def hour_floor(ts: Column | str) -> Column:
    return from_hour_index(hour_index(ts))


def local_time(ts: Column | str, zone: str) -> Column:
    """UTC wall clock to local wall clock. Not unique across zone changes, so never a key."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts))


def to_instant(text: Column | str, input_zone: str = "UTC") -> Column:
    """Parse a timestamp string to UTC; bad input gives NULL.

    Strings with an offset are instants already. Strings without one are read as wall clock in
    input_zone, whatever the session zone is.
    """
    text = F.trim(_col(text))
    has_offset = text.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d{1,2}:\d{2}")
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(text.try_cast("timestamp")), epoch())
    wall = F.convert_timezone(F.lit(input_zone), F.lit("UTC"), text.try_cast("timestamp_ntz"))
    return F.when(has_offset, instant).otherwise(wall)


def weekday_label(index: Column) -> Column:
    """Label of a Monday-0 weekday."""
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_LABELS]), index + 1)


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_LABELS]), month)


def calendar_columns(ts: Column | str) -> dict[str, Column]:
    ts = _col(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "date": F.to_date(ts),
        "week": F.weekofyear(ts),
    }


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position within a period."""
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def in_months(ts: Column | str, months: list[int]) -> Column:
    return F.month(_col(ts)).isin(months)
