"""Weather expressions: wind vector, stability flags, unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourloom.functions.numeric import flag
from hourloom.functions.timecols import in_months
from hourloom.settings import CALM_WIND, HEATING_MONTHS, INVERSION_WIND, KMH_PER_MS


def wind_vector(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Eastward and northward components of the wind blowing from a compass direction."""
    angle = F.radians(direction)
    return -speed * F.sin(angle), -speed * F.cos(angle)


def kmh_to_ms(speed: Column) -> Column:
    return speed / F.lit(KMH_PER_MS)


def calm_flag(wind: Column) -> Column:
    return flag(wind < CALM_WIND)


def inversion_flag(temperature: Column, wind: Column, ts: Column) -> Column:
    cold_and_still = (temperature < 0) & (wind < INVERSION_WIND)
    return flag(cold_and_still & in_months(ts, HEATING_MONTHS))
