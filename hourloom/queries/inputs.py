"""How the given tables play the roles of measurement, weather and station data.

events are long measurements: ts is a UTC time, event_type the measured parameter, user_id the
location. Values have two decimals, so hourly means are taken with fixed-point sums and agree
between engines to the last bit. The SQL strings are common table expressions for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions.timecols import from_hour_index
from hourloom.operators.grid import HOUR, hourly_long, hourly_wide, pivot_mean
from hourloom.sources.stations import standardise_station

PARAMETERS = {
    "click": "pm25",
    "view": "pm10",
    "error": "temp",
    "purchase": "wind_spd",
    "signup": "humidity",
}
WIDE_COLUMNS = list(PARAMETERS.values())
SCALES = {"value_scale": 2, "mean_scale": 6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameter = F.create_map(*[F.lit(x) for pair in PARAMETERS.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("location"), parameter.alias("parameter"), "ts", "value"
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complete hourly series per parameter."""
    return hourly_long(measurements(spark, sf_dir), ["parameter"], **SCALES)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complete hourly table with a column per parameter and a derived wind direction."""
    grid = hourly_wide(measurements(spark, sf_dir), WIDE_COLUMNS, **SCALES)
    return grid.withColumn("wind_dir", F.pmod(F.col("humidity") * 7, F.lit(360.0)))


def station_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse feed with its own variable names: temperature, humidity and wind speed in km/h."""
    feed = pivot_mean(measurements(spark, sf_dir), ["ts"], ["pm10", "pm25", "humidity"], scale=2)
    return feed.withColumnsRenamed({"pm10": "temp", "pm25": "wspd", "humidity": "rhum"})


def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardise_station(station_feed(spark, sf_dir))


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-year series: order totals, with totals above 300000 taken as missing readings."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("ts"),
        price.alias("value"),
        F.when(price <= 300000, price).alias("pm25"),
        F.when(price >= 50000, price).alias("pm10"),
    )


def hour_ts() -> Column:
    return from_hour_index(HOUR).alias("ts")


def steady(value: Column | str, places: int = 6) -> Column:
    """Round for comparison between engines.

    Sums taken in another order differ in the last digits, and means of decimal readings often end
    in an exact 5 at the cut. Shifting by a sliver first sends both engines the same way.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(10.0 ** -(places + 4)), places)


def steady_sql(expr: str, places: int = 6) -> str:
    return f"round({expr} + {10.0 ** -(places + 4):.{places + 4}f}::DOUBLE, {places})"


# --- the same roles as SQL -----------------------------------------------------------------------------


def mean_sql(expr: str, scale: int) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(24,{scale}))) AS DOUBLE) / CAST(nullif(count({expr}), 0) AS DOUBLE)"


def _cell(parameter: str) -> str:
    expr = f"CASE WHEN parameter = '{parameter}' THEN value END"
    return f"{mean_sql(expr, 2)} AS {parameter}"


MEAS = """meas AS (
  SELECT event_id, user_id AS location,
         CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'pm10' WHEN 'error' THEN 'temp'
              WHEN 'purchase' THEN 'wind_spd' WHEN 'signup' THEN 'humidity' END AS parameter,
         ts, value
  FROM events)"""

RESAMPLED = f"""{MEAS},
per_ts AS (SELECT parameter, ts, {mean_sql('value', 2)} AS v FROM meas GROUP BY ALL),
hourly AS (SELECT parameter, date_trunc('hour', ts) AS h, {mean_sql('v', 6)} AS value FROM per_ts GROUP BY ALL)"""

SERIES = f"""{RESAMPLED},
hours AS (SELECT parameter, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM hourly GROUP BY parameter),
series AS (SELECT g.parameter, g.h, x.value FROM hours g LEFT JOIN hourly x ON x.parameter = g.parameter AND x.h = g.h)"""

WIDE = f"""{MEAS},
wide_ts AS (SELECT ts, {', '.join(_cell(p) for p in WIDE_COLUMNS)} FROM meas GROUP BY ts),
wide_hours AS (SELECT date_trunc('hour', ts) AS h, {', '.join(f"{mean_sql(p, 6)} AS {p}" for p in WIDE_COLUMNS)}
  FROM wide_ts GROUP BY ALL),
span AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM wide_hours),
wide AS (SELECT s.h, {', '.join(WIDE_COLUMNS)}, (humidity * 7) % 360 AS wind_dir
  FROM span s LEFT JOIN wide_hours w ON w.h = s.h)"""

STATION = f"""station_ts AS (
  SELECT ts, {mean_sql("CASE WHEN parameter = 'pm10' THEN value END", 2)} AS ms_temp,
         {mean_sql("CASE WHEN parameter = 'pm25' THEN value END", 2)} / 3.6 AS ms_wind_spd,
         {mean_sql("CASE WHEN parameter = 'humidity' THEN value END", 2)} AS ms_humidity
  FROM meas WHERE parameter IN ('pm10', 'pm25', 'humidity') GROUP BY ts),
station_hours AS (SELECT date_trunc('hour', ts) AS h,
  {', '.join(f"{mean_sql(c, 6)} AS {c}" for c in ('ms_temp', 'ms_wind_spd', 'ms_humidity'))}
  FROM station_ts GROUP BY ALL)"""

ORDERS = """os AS (
  SELECT o_orderkey AS id, o_orderdate AS ts, o_totalprice AS value,
         CASE WHEN o_totalprice <= 300000 THEN o_totalprice END AS pm25,
         CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS pm10
  FROM orders)"""


def lag_sql(column: str, hours: int, name: str | None = None, by: str = "") -> str:
    return f"lag({column}, {hours}) OVER ({by} ORDER BY h) AS {name or f'{column}_lag_{hours}'}"


def roll_sql(
    column: str, how: str, hours: int, minimum: int, name: str, by: str = "", lagged: bool = True, places: int = 6
) -> str:
    last = "1 PRECEDING" if lagged else "CURRENT ROW"
    first = hours if lagged else hours - 1
    frame = f"OVER ({by} ORDER BY h ROWS BETWEEN {first} PRECEDING AND {last})"
    function = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[how]
    value = f"CASE WHEN count({column}) {frame} >= {minimum} THEN {function}({column}) {frame} END"
    return f"{steady_sql(value, places)} AS {name}"
