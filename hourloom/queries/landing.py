"""Landing, cleaning, coverage and join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions.timecols import local_time
from hourloom.operators import clean, coverage, grid, joins, profile
from hourloom.queries import inputs, query
from hourloom.queries.inputs import MEAS, RESAMPLED, SERIES, STATION, WIDE, hour_ts, mean_sql
from hourloom.settings import CENTRE_LATITUDE, CENTRE_LONGITUDE, LOCAL_ZONE, SEARCH_RADIUS_M
from hourloom.sources import files, payloads, stations


@query(f"WITH {RESAMPLED} SELECT parameter, h AS ts, value FROM hourly")
def hourly_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_instant = (
        inputs.measurements(spark, sf_dir)
        .groupBy("parameter", "ts")
        .agg(grid.mean("value", 2).alias("value"))
    )
    hourly = grid.resample_hourly(per_instant, ["value"], ["parameter"], scale=6)
    return hourly.select("parameter", hour_ts(), "value")


@query(f"WITH {SERIES} SELECT parameter, h AS ts, value FROM series")
def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.series(spark, sf_dir).select("parameter", hour_ts(), "value")


@query(f"""WITH {MEAS}, per_ts AS (SELECT location, parameter, ts, {mean_sql('value', 2)} AS v FROM meas GROUP BY ALL)
SELECT location, parameter, date_trunc('hour', ts) AS ts, {mean_sql('v', 6)} AS value FROM per_ts GROUP BY ALL""")
def hourly_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_instant = (
        inputs.measurements(spark, sf_dir)
        .groupBy("location", "parameter", "ts")
        .agg(grid.mean("value", 2).alias("value"))
    )
    hourly = grid.resample_hourly(per_instant, ["value"], ["location", "parameter"], scale=6)
    return hourly.select("location", "parameter", hour_ts(), "value")


@query(f"""WITH {MEAS}
SELECT ts, {mean_sql("CASE WHEN parameter = 'pm25' THEN value END", 2)} AS pm25,
       {mean_sql("CASE WHEN parameter = 'pm10' THEN value END", 2)} AS pm10, CAST(NULL AS DOUBLE) AS no2
FROM meas WHERE parameter IN ('pm25', 'pm10') GROUP BY ts""")
def pivot_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = grid.pivot_mean(inputs.measurements(spark, sf_dir), ["ts"], ["pm25", "pm10"], scale=2)
    wanted = T.StructType(
        [T.StructField("ts", T.TimestampNTZType())]
        + [T.StructField(c, T.DoubleType()) for c in ("pm25", "pm10", "no2")]
    )
    return clean.with_required_columns(pivoted, wanted)


@query(f"WITH {MEAS}, {STATION} SELECT ts, ms_temp, ms_wind_spd, ms_humidity FROM station_ts")
def station_unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.station_rows(spark, sf_dir).select("ts", "ms_temp", "ms_wind_spd", "ms_humidity")


@query(f"""WITH {RESAMPLED},
a AS (SELECT h, max(CASE WHEN parameter = 'pm25' THEN value END) AS pm25,
             max(CASE WHEN parameter = 'pm10' THEN value END) AS pm10
      FROM hourly WHERE parameter IN ('pm25', 'pm10') GROUP BY h),
w AS (SELECT h, max(CASE WHEN parameter = 'temp' THEN value END) AS temp,
             max(CASE WHEN parameter = 'wind_spd' THEN value END) AS wind_spd
      FROM hourly WHERE parameter IN ('temp', 'wind_spd') GROUP BY h)
SELECT a.h AS ts, pm25, pm10, temp, wind_spd FROM a JOIN w ON w.h = a.h""")
def join_weather_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.measurements(spark, sf_dir)

    def hourly(names: list[str]) -> DataFrame:
        return grid.resample_hourly(grid.pivot_mean(rows, ["ts"], names, scale=2), names, scale=6)

    joined = joins.join_series(hourly(["pm25", "pm10"]), hourly(["temp", "wind_spd"]))
    return joined.select(hour_ts(), "pm25", "pm10", "temp", "wind_spd")


@query(f"""WITH {WIDE}, {STATION}
SELECT w.h AS ts, pm25, temp, ms_temp, ms_wind_spd, ms_humidity
FROM wide w LEFT JOIN station_hours s ON s.h = w.h""")
def join_station_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["ms_temp", "ms_wind_spd", "ms_humidity"]
    joined = joins.attach_station(
        inputs.wide(spark, sf_dir), inputs.station_rows(spark, sf_dir), columns, scale=6
    )
    return joined.select(hour_ts(), "pm25", "temp", *columns)


@query(f"""WITH {WIDE}
SELECT count(*) AS retrieved_rows, min(h) AS datetime_min, max(h) AS datetime_max,
       count(*) - count(pm25) AS missing_pm25, count(*) - count(pm10) AS missing_pm10,
       'ts,pm25,pm10' AS columns, 'UTC' AS zone FROM wide""")
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = inputs.wide(spark, sf_dir).select(hour_ts(), "pm25", "pm10")
    return files.dataset_manifest(hourly, ["pm25", "pm10"], extra={"zone": "UTC"})


@query(f"""WITH {WIDE}
SELECT (SELECT count(DISTINCT location) FROM meas) AS station_count,
       (SELECT bool_or(parameter = 'pm25') FROM meas) AS pm25_in_stations,
       (SELECT bool_or(parameter = 'pm10') FROM meas) AS pm10_in_stations,
       count(*) AS modelled_rows, count(pm25) AS pm25_modelled_valid, count(pm10) AS pm10_modelled_valid,
       'stations' AS recommended_source FROM wide""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.source_coverage(
        inputs.measurements(spark, sf_dir), inputs.wide(spark, sf_dir), ["pm25", "pm10"]
    )


@query(f"""WITH {MEAS} SELECT parameter, count(*) AS n_rows, count(value) AS n_valid,
       count(DISTINCT location) AS n_locations FROM meas GROUP BY parameter""")
def parameter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = coverage.parameter_coverage(inputs.measurements(spark, sf_dir))
    return result.select("parameter", "n_rows", "n_valid", "n_locations")


@query(f"""WITH {MEAS} SELECT parameter, count(*) AS n_rows, count(value) AS n_valid
FROM meas WHERE ts >= (SELECT max(ts) FROM meas) - INTERVAL 7 DAY GROUP BY parameter""")
def probe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = coverage.probe_last_days(inputs.measurements(spark, sf_dir), 7)
    return recent.groupBy("parameter").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_valid"))


RAW_TEXT = """raw AS (
  SELECT event_id,
         CASE WHEN event_type = 'signup' AND value < 5 THEN 'not a time' ELSE CAST(ts AS VARCHAR) END AS ts_text,
         CASE WHEN value > 90 THEN 'n/a' WHEN value > 60 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS value_text
  FROM events)"""


@query(f"""WITH {RAW_TEXT}
SELECT event_id, TRY_CAST(ts_text AS TIMESTAMP) AS ts,
       CASE WHEN NOT isnan(TRY_CAST(value_text AS DOUBLE)) THEN TRY_CAST(value_text AS DOUBLE) END AS value
FROM raw WHERE TRY_CAST(ts_text AS TIMESTAMP) IS NOT NULL""")
def coerce_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, value = F.col("ts"), F.col("value")
    raw = inputs.table(spark, sf_dir, "events").select(
        "event_id",
        F.when((F.col("event_type") == "signup") & (value < 5), "not a time")
        .otherwise(ts.cast("string"))
        .alias("ts"),
        F.when(value > 90, "n/a").when(value > 60, "NaN").otherwise(value.cast("string")).alias("value"),
    )
    return clean.drop_missing(clean.coerce(raw, ["ts"], ["value"]), ["ts"])


@query(f"""WITH {MEAS} SELECT event_id, parameter, ts, value FROM meas
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'""")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.measurements(spark, sf_dir).select("event_id", "parameter", "ts", "value")
    return clean.between_dates(rows, "2024-01-05", "2024-01-20")


@query(f"""WITH {WIDE} SELECT h AS ts, pm25, pm10, temp, wind_spd, humidity FROM wide
WHERE pm25 IS NOT NULL AND pm10 IS NOT NULL AND temp IS NOT NULL AND wind_spd IS NOT NULL AND humidity IS NOT NULL""")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.complete_cases(inputs.wide(spark, sf_dir), inputs.WIDE_COLUMNS)
    return rows.select(hour_ts(), *inputs.WIDE_COLUMNS)


@query(f"""WITH {WIDE}, m AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS 'column', count(*) - count({c}) AS n_missing, 100.0 * CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS p FROM wide"
    for c in inputs.WIDE_COLUMNS)})
SELECT "column", n_missing, round(p, 6) AS pct_missing, p > 50 AS mostly_missing FROM m""")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = clean.missing_report(inputs.wide(spark, sf_dir), inputs.WIDE_COLUMNS)
    return report.withColumn("pct_missing", F.round("pct_missing", 6))


@query(f"""WITH {MEAS}, g AS (SELECT parameter,
  date_diff('microsecond', lag(ts) OVER (PARTITION BY parameter ORDER BY ts), ts) AS gap FROM meas),
m AS (SELECT parameter, median(gap) / 3.6e9 AS hours, count(gap) AS n FROM g GROUP BY parameter)
SELECT parameter, round(hours, 9) AS median_hours, n AS n_gaps, abs(hours * 3600 - 3600) <= 600 AS is_hourly FROM m""")
def frequency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = clean.frequency_check(inputs.measurements(spark, sf_dir), ["parameter"])
    return result.withColumn("median_hours", F.round("median_hours", 9))


@query(f"""WITH {MEAS}, g AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM meas)
SELECT round(median(gap) / 3.6e9, 9) AS median_hours, count(gap) AS n_gaps FROM g""")
def gap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = clean.median_gap(inputs.measurements(spark, sf_dir))
    return result.withColumn("median_hours", F.round("median_hours", 9))


@query(f"""WITH {MEAS} SELECT parameter, CAST(hour(ts + INTERVAL 6 HOUR) AS INTEGER) AS hour,
       {mean_sql('value', 2)} AS mean, count(value) AS "count"
FROM meas GROUP BY ALL""")
def local_hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.measurements(spark, sf_dir).withColumn("wall", local_time("ts", LOCAL_ZONE))
    return profile.hour_profile(rows, "wall", keys=["parameter"], scale=2).drop("std")


@query(f"""WITH {MEAS} SELECT event_id, parameter, ts, value FROM meas WHERE parameter IN ('pm25', 'pm10')
UNION ALL SELECT event_id, parameter, ts, value FROM meas WHERE parameter NOT IN ('pm25', 'pm10')""")
def union_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.measurements(spark, sf_dir).select("event_id", "parameter", "ts", "value")
    pollutants = F.col("parameter").isin("pm25", "pm10")
    # chunks may arrive with their columns in another order
    rest = rows.where(~pollutants).select("value", "ts", "parameter", "event_id")
    return rows.where(pollutants).unionByName(rest)


@query(f"WITH {WIDE} SELECT h AS ts, pm25, pm10 FROM wide ORDER BY h")
def sorted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.wide(spark, sf_dir).select(hour_ts(), "pm25", "pm10").orderBy("ts")


# stations get coordinates around the centre from their account balance
GEO_SQL = """geo AS (
  SELECT s_suppkey AS station_id, s_name AS name,
         43.2220 + (s_acctbal - 5000) / 20000 AS latitude,
         76.8512 + ((s_acctbal * 7) % 1000 - 500) / 2000 AS longitude FROM supplier),
d AS (SELECT *, 2 * 6371000.0 * asin(least(1.0, sqrt(
        pow(sin(radians(latitude - 43.2220) / 2), 2)
        + cos(radians(latitude)) * cos(radians(43.2220)) * pow(sin(radians(longitude - 76.8512) / 2), 2)))) AS dist
      FROM geo)"""


def station_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("s_acctbal")
    return inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station_id"),
        F.col("s_name").alias("name"),
        (F.lit(CENTRE_LATITUDE) + (balance - 5000) / 20000).alias("latitude"),
        (F.lit(CENTRE_LONGITUDE) + ((balance * 7) % 1000 - 500) / 2000).alias("longitude"),
    )


@query(f"WITH {GEO_SQL} SELECT station_id, name, round(dist, 3) AS distance_m FROM d WHERE dist <= 25000")
def radius_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = stations.within_radius(
        station_points(spark, sf_dir), CENTRE_LATITUDE, CENTRE_LONGITUDE, SEARCH_RADIUS_M
    )
    return near.select("station_id", "name", F.round("distance_m", 3).alias("distance_m"))


@query(f"WITH {GEO_SQL} SELECT station_id, name, round(dist, 3) AS distance_m FROM d ORDER BY dist, station_id LIMIT 1")
def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = stations.pick_station(station_points(spark, sf_dir), None, CENTRE_LATITUDE, CENTRE_LONGITUDE)
    return picked.select("station_id", "name", F.round("distance_m", 3).alias("distance_m"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       coalesce(json_extract_string(props, '$.unit'), 'unknown') AS unit FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select(
        "event_id",
        payloads.json_field("props", "$.k").try_cast("bigint").alias("k"),
        payloads.json_field("props", "$.unit", "unknown").alias("unit"),
    )


@query("""SELECT event_id, date_trunc('second', ts) AS ts, event_type AS parameter, value, 'ug' AS unit,
       'L' || CAST(user_id AS VARCHAR) AS location, user_id / 100.0::DOUBLE AS latitude, CAST(NULL AS DOUBLE) AS longitude FROM events
UNION ALL SELECT event_id, date_trunc('second', ts) - INTERVAL 5 HOUR, event_type || '_offset', NULL, NULL, NULL, NULL, NULL
FROM events WHERE event_type <> 'error'""")
def payload_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records: one with a Z time, one with an offset, and one whose time cannot be read."""
    kind = F.col("event_type")

    def record(utc, parameter, **given):
        cells = {"value": F.lit(None), "unit": F.lit(None), "location": F.lit(None), "latitude": F.lit(None), **given}
        return F.struct(
            F.struct(utc.alias("utc")).alias("date"),
            parameter.alias("parameter"),
            cells["value"].cast("double").alias("value"),
            cells["unit"].cast("string").alias("unit"),
            cells["location"].cast("string").alias("location"),
            F.col("event_id").cast("string").alias("city"),
            F.lit(None).cast("string").alias("country"),
            F.struct(
                cells["latitude"].cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude")
            ).alias("coordinates"),
        )

    place = F.concat(F.lit("L"), F.col("user_id").cast("string"))
    told = record(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), kind,
        value=F.col("value"), unit=F.lit("ug"), location=place, latitude=F.col("user_id") / 100.0,
    )
    offset = F.when(kind == "error", "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:00'"))
    unread = record(F.lit("not a time"), kind)
    records = F.array(told, record(offset, F.concat(kind, F.lit("_offset"))), unread)
    payload = inputs.table(spark, sf_dir, "events").select(records.alias("results"))
    return payloads.flatten_measurements(payload).select(
        F.col("city").cast("bigint").alias("event_id"), "ts", "parameter", "value", "unit", "location", "latitude", "longitude"
    )


@query("""SELECT event_id, date_trunc('minute', ts) + to_hours(i) AS ts, value + i AS temp,
       CASE WHEN i < 2 THEN CAST(user_id AS DOUBLE) END AS humidity
FROM (SELECT *, unnest(range(3)) AS i FROM events)""")
def payload_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of three hours and two humidities, with zone-less times."""
    hours = F.array(*[F.lit(i) for i in range(3)])

    def later(i):
        return F.date_format(F.timestamp_add("HOUR", i, F.col("ts")), "yyyy-MM-dd'T'HH:mm")

    arrays = F.struct(
        F.transform(hours, later).alias("time"),
        F.array_repeat(F.col("event_id").cast("double"), 3).alias("id"),
        F.transform(hours, lambda i: F.col("value") + i).alias("temperature_2m"),
        F.array_repeat(F.col("user_id").cast("double"), 2).alias("relative_humidity_2m"),
    )
    payload = inputs.table(spark, sf_dir, "events").select(arrays.alias("hourly"))
    names = {"id": "event_id", "temperature_2m": "temp", "relative_humidity_2m": "humidity"}
    rows = payloads.flatten_hourly(payload, names)
    return rows.withColumn("event_id", F.col("event_id").cast("bigint"))


@query("""SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'Unknown' ELSE s_name END AS name,
       s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AS has_parameter FROM supplier""")
def payload_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station lists whose parameters are plain strings, objects with an id, or missing."""
    key = F.col("s_suppkey")
    listed = (
        F.when(key % 7 == 0, F.lit(None).cast("array<string>"))
        .when(key % 3 == 0, F.array(F.lit("pm10"), F.lit('{"id": "no2"}')))
        .when(key % 3 == 1, F.array(F.lit("pm10"), F.lit("pm25")))
        .otherwise(F.array(F.lit('{"id": "pm25"}')))
    )
    station = F.struct(F.when(key % 5 != 0, F.col("s_name")).alias("name"), listed.alias("parameters"))
    payload = inputs.table(spark, sf_dir, "supplier").select(F.array(station).alias("results"))
    return payloads.stations_with_parameter(payload, "pm25")
