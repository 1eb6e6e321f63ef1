"""Window, calendar and composite feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions.numeric import flag
from hourloom.functions.timecols import cyclical, epoch, in_months, month_label, weekday_label
from hourloom.operators.grid import HOUR
from hourloom.operators.joins import attach_station
from hourloom.operators.windows import Feature, add_features, difference, lag, lead, rolling
from hourloom.plans import features as sets
from hourloom.queries import inputs, query
from hourloom.queries.inputs import SERIES, STATION, WIDE, hour_ts, lag_sql, roll_sql, steady, steady_sql
from hourloom.settings import HEATING_MONTHS, HORIZONS, TARGET_LAGS, WINTER_MONTHS

BY = "PARTITION BY parameter"
DERIVED = ("_roll_", "_sin", "_cos", "_diff_", "wind_u", "wind_v", "_log", "_bias", "_x_")


def rounded_features(df: DataFrame, places: int = 6) -> DataFrame:
    """Round the computed columns for comparison."""
    names = [c for c in df.columns if any(d in c for d in DERIVED)]
    return df.withColumns({c: steady(c, places) for c in names})


def on_series(spark: SparkSession, sf_dir: str, features: list[Feature], **options) -> DataFrame:
    table = add_features(inputs.series(spark, sf_dir), features, ["parameter"], **options)
    return rounded_features(table.select("parameter", hour_ts(), *[f.name for f in features]))


def on_wide(grid: DataFrame, features: list[Feature], targets: list[Feature] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    every = [*features, *targets]
    table = add_features(grid, every, keep=[HOUR, *keep])
    return rounded_features(table.select(hour_ts(), *keep, *[f.name for f in every]))


def series_sql(columns: list[str]) -> str:
    return f"WITH {SERIES} SELECT parameter, h AS ts, {', '.join(columns)} FROM series"


LAGS = [lag(f"value_lag_{k}", "value", k) for k in TARGET_LAGS]
LAGS_SQL = [lag_sql("value", k, by=BY) for k in TARGET_LAGS]


@query(series_sql(LAGS_SQL))
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_series(spark, sf_dir, LAGS)


MIN_COUNT = [(how, 24, 12) for how in ("mean", "std", "min", "max")] + [(how, 168, 84) for how in ("mean", "std")]
FULL = [(how, w, w) for w in (6, 24, 168) for how in ("mean", "std", "max")]


def rolling_set(column: str, shapes: list[tuple[str, int, int]]) -> list[Feature]:
    return [rolling(f"{column}_roll_{how}_{w}", column, how, w, m) for how, w, m in shapes]


def rolling_sql(column: str, shapes: list[tuple[str, int, int]], by: str = "") -> list[str]:
    return [roll_sql(column, how, w, m, f"{column}_roll_{how}_{w}", by) for how, w, m in shapes]


@query(series_sql(rolling_sql("value", MIN_COUNT, BY)))
def rolling_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_series(spark, sf_dir, rolling_set("value", MIN_COUNT))


@query(series_sql(rolling_sql("value", FULL, BY)))
def rolling_full_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_series(spark, sf_dir, rolling_set("value", FULL))


@query(f"WITH {SERIES} SELECT parameter, h AS ts, {roll_sql('value', 'mean', 24, 24, 'value_roll_mean', BY, lagged=False)} FROM series")
def trailing_mean_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_series(spark, sf_dir, [rolling("value_roll_mean", "value", "mean", 24, lagged=False)])


def diff_sql(column: str, hours: int, lagged: bool, name: str, by: str = "") -> str:
    over = f"OVER ({by} ORDER BY h)"
    ends = (f"lag({column}, 1) {over}", hours + 1) if lagged else (column, hours)
    change = f"{ends[0]} - lag({column}, {ends[1]}) {over}"
    return f"{steady_sql(change)} AS {name}"


@query(series_sql([
    diff_sql("value", 1, False, "value_diff_1", BY), diff_sql("value", 24, False, "value_diff_24", BY),
    diff_sql("value", 1, True, "lagged_diff_1", BY), diff_sql("value", 24, True, "lagged_diff_24", BY),
]))
def diff_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_series(spark, sf_dir, [
        difference("value_diff_1", "value", 1, lagged=False),
        difference("value_diff_24", "value", 24, lagged=False),
        difference("lagged_diff_1", "value", 1, lagged=True),
        difference("lagged_diff_24", "value", 24, lagged=True),
    ])


@query(series_sql([f"lead(value, {k}) OVER ({BY} ORDER BY h) AS target_{k}h" for k in HORIZONS]))
def lead_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_series(spark, sf_dir, [lead(f"target_{k}h", "value", k) for k in HORIZONS])


@query(series_sql(LAGS_SQL + rolling_sql("value", MIN_COUNT, BY) + ["lead(value, 24) OVER (" + BY + " ORDER BY h) AS target_24h"]))
def halo_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows cut into ten-day buckets, so that several buckets exist within the month."""
    wanted = LAGS + rolling_set("value", MIN_COUNT) + [lead("target_24h", "value", 24)]
    return on_series(spark, sf_dir, wanted, bucket_hours=240)


DAILY_SQL = """daily AS (SELECT l_suppkey AS suppkey, CAST(l_shipdate AS DATE) AS day,
  CAST(sum(CAST(l_quantity AS DECIMAL(24,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {DAILY_SQL} SELECT suppkey, CAST(day AS TIMESTAMP) AS ts, value,
  lag(value, 1) OVER (PARTITION BY suppkey ORDER BY day) AS value_lag_1,
  {steady_sql('CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END')} AS value_roll_mean_7
FROM daily WINDOW w AS (PARTITION BY suppkey ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def many_series_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series: observations stay rows, one window per supplier series."""
    day = F.to_date("l_shipdate")
    daily = (
        inputs.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("suppkey"), F.unix_date(day).cast("bigint").alias(HOUR))
        .agg(F.sum(F.col("l_quantity").cast("decimal(24,2)")).cast("double").alias("value"))
    )
    wanted = [lag("value_lag_1", "value", 1), rolling("value_roll_mean_7", "value", "mean", 7, 3)]
    table = add_features(daily, wanted, ["suppkey"], bucket_hours=None)
    ts = F.timestamp_add("DAY", HOUR, epoch()).alias("ts")
    return rounded_features(table.select("suppkey", ts, "value", *[f.name for f in wanted]))


CALENDAR_SQL = """CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(o_orderdate AS DATE) AS date, CAST(week(o_orderdate) AS INTEGER) AS week"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts")
    )


@query(f"""SELECT o_orderkey AS id, o_orderdate AS ts, {CALENDAR_SQL},
  CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year FROM orders""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.add_calendar(orders(spark, sf_dir)).withColumn("day_of_year", F.dayofyear("ts"))


def cyc_sql(expr: str, period: int, name: str) -> str:
    angle = f"2 * pi() * ({expr}) / {period}.0"
    return f"{steady_sql(f'sin({angle})')} AS {name}_sin, {steady_sql(f'cos({angle})')} AS {name}_cos"


@query(f"""SELECT event_id AS id, {cyc_sql('hour(ts)', 24, 'hour')}, {cyc_sql('month(ts)', 12, 'month')},
  {cyc_sql('isodow(ts) - 1', 7, 'dow')} FROM events""")
def cyclical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {}
    for name, value, period in (("hour", F.hour("ts"), 24), ("month", F.month("ts"), 12), ("dow", F.weekday("ts"), 7)):
        columns[f"{name}_sin"], columns[f"{name}_cos"] = cyclical(value, period)
    rows = inputs.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    return rounded_features(rows.withColumns(columns).drop("ts"))


@query("""SELECT o_orderkey AS id, CASE WHEN month(o_orderdate) IN (10, 11, 12, 1, 2, 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS heating_season,
  CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 1.0 ELSE 0.0 END::DOUBLE AS is_winter FROM orders""")
def season_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select(
        "id",
        flag(in_months("ts", HEATING_MONTHS)).alias("heating_season"),
        flag(in_months("ts", WINTER_MONTHS)).alias("is_winter"),
    )


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%b') AS month_label, strftime(o_orderdate, '%a') AS weekday_label,
  strftime(o_orderdate, '%Y-%m') AS year_month FROM orders""")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select(
        "id",
        month_label(F.month("ts")).alias("month_label"),
        weekday_label(F.weekday("ts")).alias("weekday_label"),
        F.date_format("ts", "yyyy-MM").alias("year_month"),
    )


def _weather_sql() -> list[str]:
    over = "OVER (ORDER BY h)"
    temp, wind = f"lag(temp, 1) {over}", f"lag(wind_spd, 1) {over}"
    out = [
        f"{steady_sql('-wind_spd * sin(radians(wind_dir))')} AS wind_u",
        f"{steady_sql('-wind_spd * cos(radians(wind_dir))')} AS wind_v",
    ]
    out += [lag_sql(c, k) for k in (1, 3, 6, 24) for c in ("temp", "wind_spd", "humidity")]
    for c in ("temp", "wind_spd", "humidity", "blh"):
        out += rolling_sql(c, [(how, w, w) for w in (6, 24) for how in ("mean", "std")])
    out += [
        f"{steady_sql(f'ln(1 + lag(blh, 1) {over})')} AS blh_log", lag_sql("blh", 1), lag_sql("blh", 24),
        f"CASE WHEN {temp} < 0 AND {wind} < 2.0 AND month(h) IN (10, 11, 12, 1, 2, 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS inversion_flag",
        f"CASE WHEN {wind} < 1.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS calm_flag",
        f"{steady_sql(f'{temp} * {wind}')} AS temp_x_wind",
    ]
    return out


def _extra_sql() -> list[str]:
    return [lag_sql("precip", 1), lag_sql("precip", 6)] + [lag_sql(c, 1) for c in ("no2", "aod", "dust")]


# temperature is shifted below zero for some hours; the other companions derive from the measured columns
FULL_WIDE = f"""{WIDE}, rich AS (SELECT h, pm25, pm10, temp - 20 AS temp, wind_spd / 10 AS wind_spd, humidity, wind_dir,
  pm25 * 10 AS blh, humidity / 4 AS precip, pm10 / 2 AS no2, temp / 8 AS aod, wind_spd / 2 AS dust FROM wide)"""


RICH_COLUMNS = ["pm25", "pm10", "temp", "wind_spd", "humidity", "wind_dir", "blh", "precip", "no2", "aod", "dust"]


def rich_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.wide(spark, sf_dir).select(
        HOUR, "pm25", "pm10", (F.col("temp") - 20).alias("temp"), (F.col("wind_spd") / 10).alias("wind_spd"),
        "humidity", "wind_dir", (F.col("pm25") * 10).alias("blh"), (F.col("humidity") / 4).alias("precip"),
        (F.col("pm10") / 2).alias("no2"), (F.col("temp") / 8).alias("aod"), (F.col("wind_spd") / 2).alias("dust"),
    )


@query(f"WITH {FULL_WIDE} SELECT h AS ts, {', '.join(_weather_sql() + _extra_sql())} FROM rich")
def weather_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = rich_wide(spark, sf_dir)
    return on_wide(grid, sets.reanalysis_features(set(grid.columns)))


STATION_COLUMNS = ["ms_humidity", "ms_temp", "ms_wind_spd"]
STATION_FEATURES_SQL = [lag_sql(c, k) for c in STATION_COLUMNS for k in (1, 6, 24)] + [
    roll_sql(c, "mean", 24, 24, f"{c}_roll_mean_24") for c in STATION_COLUMNS
] + [
    f"{steady_sql('lag(temp, 1) OVER (ORDER BY h) - lag(ms_temp, 1) OVER (ORDER BY h)')} AS temp_bias",
    f"{steady_sql('lag(wind_spd, 1) OVER (ORDER BY h) - lag(ms_wind_spd, 1) OVER (ORDER BY h)')} AS wind_bias",
]


@query(f"""WITH {WIDE}, {STATION}, j AS (SELECT w.h, temp, wind_spd, ms_temp, ms_wind_spd, ms_humidity
  FROM wide w LEFT JOIN station_hours s ON s.h = w.h)
SELECT h AS ts, {', '.join(STATION_FEATURES_SQL)} FROM j""")
def station_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = attach_station(
        inputs.wide(spark, sf_dir), inputs.station_rows(spark, sf_dir), STATION_COLUMNS, scale=6
    )
    return on_wide(grid, sets.station_features(STATION_COLUMNS, set(grid.columns)))


def _next_hour_sql(target: str, companion: str, companion_lags: tuple[int, ...]) -> str:
    columns = [
        "CAST(hour(h) AS INTEGER) AS hour", "CAST(isodow(h) - 1 AS INTEGER) AS day_of_week",
        "CAST(month(h) AS INTEGER) AS month", "CAST(year(h) AS INTEGER) AS year",
        "CAST(dayofyear(h) AS INTEGER) AS day_of_year", cyc_sql("hour(h)", 24, "hour"), cyc_sql("month(h)", 12, "month"),
    ]
    columns += [lag_sql(target, k) for k in TARGET_LAGS] + rolling_sql(target, MIN_COUNT)
    columns += [diff_sql(target, k, False, f"{target}_diff_{k}") for k in (1, 24)]
    columns += [lag_sql(companion, k) for k in companion_lags]
    columns.append(roll_sql(companion, "mean", 24, 12, f"{companion}_roll_mean_24"))
    columns.append(f"lead({target}, 1) OVER (ORDER BY h) AS y")
    return f"WITH {WIDE}, f AS (SELECT h AS ts, {', '.join(columns)} FROM wide) SELECT * FROM f WHERE y IS NOT NULL"


def _next_hour(spark: SparkSession, sf_dir: str, target: str, companion: str, lags: tuple[int, ...]) -> DataFrame:
    wanted = sets.next_hour_features(target, companion, lags)
    return on_wide(inputs.wide(spark, sf_dir), wanted, [lead("y", target, 1)]).where(F.col("y").isNotNull())


@query(_next_hour_sql("pm25", "pm10", (1, 24)))
def feature_set_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_hour(spark, sf_dir, "pm25", "pm10", (1, 24))


@query(_next_hour_sql("pm10", "pm25", (1,)))
def feature_set_t1_pm10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_hour(spark, sf_dir, "pm10", "pm25", (1,))


def _multi_source_sql(target: str) -> str:
    columns = [lag_sql(target, k) for k in TARGET_LAGS] + rolling_sql(target, FULL)
    columns += [diff_sql(target, k, True, f"{target}_diff_{k}") for k in (1, 24)]
    columns += [cyc_sql("hour(h)", 24, "hour"), cyc_sql("month(h)", 12, "month"), cyc_sql("isodow(h) - 1", 7, "dow")]
    columns += [
        "CAST(dayofyear(h) AS INTEGER) AS day_of_year",
        "CASE WHEN month(h) IN (10, 11, 12, 1, 2, 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS heating_season",
        "CASE WHEN month(h) IN (12, 1, 2) THEN 1.0 ELSE 0.0 END::DOUBLE AS is_winter",
    ]
    columns += _weather_sql() + _extra_sql()
    columns += [f"lead({target}, {k}) OVER (ORDER BY h) AS target_{k}h" for k in HORIZONS]
    return f"WITH {FULL_WIDE}, f AS (SELECT h AS ts, {', '.join(columns)} FROM rich) SELECT * FROM f WHERE target_1h IS NOT NULL"


MULTI_SOURCE_SQL = {target: _multi_source_sql(target) for target in ("pm25", "pm10")}


def _multi_source(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    grid = rich_wide(spark, sf_dir)
    wanted = sets.multi_source_features(target, grid.columns)
    return on_wide(grid, wanted, sets.horizon_targets(target)).where(F.col("target_1h").isNotNull())


@query(MULTI_SOURCE_SQL["pm25"])
def feature_set_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi_source(spark, sf_dir, "pm25")


@query(MULTI_SOURCE_SQL["pm10"])
def feature_set_v2_pm10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multi_source(spark, sf_dir, "pm10")


def _long_sql(target: str) -> str:
    leads = ", ".join(f"lead({target}, {k}) OVER (ORDER BY h) AS t{k}" for k in HORIZONS)
    rows = f"(SELECT h AS ts, {target} AS value, lag({target}, 1) OVER (ORDER BY h) AS lag_1, {leads} FROM wide)"
    return " UNION ALL ".join(
        f"SELECT '{target}' AS pollutant, ts, value, lag_1, {k} AS horizon, t{k} AS y FROM {rows} WHERE t{k} IS NOT NULL" for k in HORIZONS
    )


@query(f"WITH {WIDE} {_long_sql('pm25')} UNION ALL {_long_sql('pm10')}")
def multi_horizon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pollutant, ts, value, lag_1, horizon, y) of both pollutants."""

    def long(target: str) -> DataFrame:
        wanted = [lag("lag_1", target, 1), *sets.horizon_targets(target)]
        table = add_features(inputs.wide(spark, sf_dir), wanted, keep=[HOUR, target])
        rows = sets.long_targets(table, HORIZONS, [HOUR, target, "lag_1"])
        return rows.select(F.lit(target).alias("pollutant"), hour_ts(), F.col(target).alias("value"), "lag_1", "horizon", "y")

    return long("pm25").unionByName(long("pm10"))
