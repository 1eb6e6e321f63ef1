"""Audits, calendar profiles, distributions and extremes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions.distributions import (
    CENTRAL_DEN,
    CENTRAL_NUM,
    FAR_DEN,
    FAR_NUM,
    MIDDLE_DEN,
    MIDDLE_NUM,
)
from hourloom.functions.timecols import month_label
from hourloom.operators import distribution, profile
from hourloom.operators.windows import add_features, rolling
from hourloom.plans import reports
from hourloom.queries import inputs, query
from hourloom.queries.inputs import MEAS, ORDERS, SERIES, WIDE, hour_ts, mean_sql, roll_sql, steady
from hourloom.settings import GUIDELINES

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def union_sql(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.replace("$c", c) for c in columns)


@query(f"""WITH {MEAS} SELECT parameter, CAST(ts AS DATE) AS date, {mean_sql('value', 2)} AS mean,
       CASE parameter WHEN 'pm25' THEN 15.0::DOUBLE WHEN 'pm10' THEN 45.0::DOUBLE END AS guideline_daily,
       CASE parameter WHEN 'pm25' THEN 5.0::DOUBLE WHEN 'pm10' THEN 15.0::DOUBLE END AS guideline_annual
FROM meas WHERE value IS NOT NULL GROUP BY ALL""")
def daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = profile.daily_mean(inputs.measurements(spark, sf_dir), keys=["parameter"], scale=2)
    return daily.withColumns({f"guideline_{p}": reports.guideline_of("parameter", p) for p in ("daily", "annual")})


@query(f"""WITH {MEAS}, p AS (SELECT parameter, CAST(hour(ts) AS INTEGER) AS hour, {mean_sql('value', 2)} AS mean,
  stddev_samp(value) AS std, count(value) AS "count" FROM meas GROUP BY ALL)
SELECT parameter, hour, mean, round(std, 6) AS std, "count", round(mean - std, 6) AS band_low,
       round(mean + std, 6) AS band_high,
       CASE parameter WHEN 'pm25' THEN 15.0::DOUBLE WHEN 'pm10' THEN 45.0::DOUBLE END AS guideline FROM p""")
def diurnal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = profile.hour_profile(inputs.measurements(spark, sf_dir), keys=["parameter"], scale=2)
    return rounded(reports.profile_band(hours, reports.guideline_of("parameter", "daily")), ["std", "band_low", "band_high"])


@query(f"""WITH {MEAS}, p AS (SELECT parameter, CAST(hour(ts) AS INTEGER) AS hour, {mean_sql('value', 2)} AS mean
  FROM meas GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY mean DESC, hour) AS hi,
             row_number() OVER (PARTITION BY parameter ORDER BY mean, hour) AS lo FROM p)
SELECT parameter, max(CASE WHEN hi = 1 THEN hour END) AS peak_hour, max(CASE WHEN hi = 1 THEN mean END) AS peak_mean,
       max(CASE WHEN lo = 1 THEN hour END) AS lowest_hour, max(CASE WHEN lo = 1 THEN mean END) AS lowest_mean
FROM r GROUP BY parameter""")
def peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = profile.hour_profile(inputs.measurements(spark, sf_dir), keys=["parameter"], scale=2)
    return profile.extreme_bucket(hours, "hour", ["parameter"])


@query(f"""WITH {ORDERS} SELECT CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, {mean_sql('value', 2)} AS mean,
       round(stddev_samp(value), 4) AS std, count(value) AS "count" FROM os GROUP BY ALL""")
def weekly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.weekday_profile(inputs.order_series(spark, sf_dir), scale=2), ["std"], 4)


@query(f"""WITH {ORDERS} SELECT CAST(month(ts) AS INTEGER) AS month, {mean_sql('value', 2)} AS mean,
       round(stddev_samp(value), 4) AS std, count(value) AS "count", strftime(min(ts), '%b') AS label
FROM os GROUP BY ALL""")
def monthly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = profile.month_profile(inputs.order_series(spark, sf_dir), scale=2)
    return rounded(months, ["std"], 4).withColumn("label", month_label(F.col("month")))


@query(f"WITH {ORDERS} SELECT CAST(year(ts) AS INTEGER) AS year, {mean_sql('value', 2)} AS mean FROM os GROUP BY ALL")
def annual_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.annual_mean(inputs.order_series(spark, sf_dir), scale=2)


@query(f"""WITH {ORDERS} SELECT strftime(ts, '%Y-%m') AS year_month, count(*) AS n_rows,
       round(100.0 * CAST(count(*) - count(pm25) AS DOUBLE) / count(*), 6) AS pm25_missing_pct,
       round(100.0 * CAST(count(*) - count(pm10) AS DOUBLE) / count(*), 6) AS pm10_missing_pct
FROM os GROUP BY ALL""")
def monthly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["pm25", "pm10", "temp", "humidity", "precip", "wind_spd"]
    months = profile.monthly_coverage(inputs.order_series(spark, sf_dir), wanted)
    return rounded(months, ["pm25_missing_pct", "pm10_missing_pct"])


@query(f"""WITH e AS (SELECT ts + to_months(CAST(json_extract_string(props, '$.k') AS INTEGER) % 12) AS ts, value FROM events),
c AS (SELECT hour(ts) AS hour, {', '.join(mean_sql(f'CASE WHEN month(ts) = {m} THEN value END', 2) + f' AS m{m}' for m in range(1, 13))}
      FROM e WHERE value IS NOT NULL GROUP BY ALL)
SELECT CAST(h.hour AS INTEGER) AS hour, {', '.join(f'm{m}' for m in range(1, 13))}
FROM (SELECT unnest(generate_series(0, 23)) AS hour) h LEFT JOIN c ON c.hour = h.hour""")
def season_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events cover one month; props.k moves each event by whole months to fill the year."""
    shift = F.get_json_object("props", "$.k").cast("int") % 12
    rows = inputs.table(spark, sf_dir, "events").select(
        (F.col("ts") + F.make_ym_interval(F.lit(0), shift)).alias("ts"), "value"
    )
    return profile.season_matrix(rows, scale=2)


@query(f"""WITH {WIDE}, g AS (SELECT h, date_diff('microsecond', lag(h) OVER (ORDER BY h), h) AS gap FROM wide)
SELECT count(*) AS n_rows, min(h) AS first_ts, max(h) AS last_ts,
       round(100.0 * CAST(count(*) - count(pm25) AS DOUBLE) / count(*), 2) AS pm25_missing_pct,
       round(100.0 * CAST(count(*) - count(pm10) AS DOUBLE) / count(*), 2) AS pm10_missing_pct,
       round(date_diff('microsecond', min(h), max(h)) / 86400e6, 6) AS span_days,
       CASE WHEN round(100.0 * (count(*) - count(pm25)) / count(*), 2) < 5 THEN '✓'
            WHEN round(100.0 * (count(*) - count(pm25)) / count(*), 2) < 20 THEN '⚠' ELSE '✗' END AS pm25_status,
       CASE WHEN round(100.0 * (count(*) - count(pm10)) / count(*), 2) < 5 THEN '✓'
            WHEN round(100.0 * (count(*) - count(pm10)) / count(*), 2) < 20 THEN '⚠' ELSE '✗' END AS pm10_status,
       count(*) - count(DISTINCT h) AS n_duplicates,
       (SELECT median(gap) / 3.6e9 FROM g) AS median_hours FROM wide""")
def series_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = inputs.wide(spark, sf_dir).select(hour_ts(), "pm25", "pm10")
    return rounded(profile.series_audit(hourly, ["pm25", "pm10"]), ["span_days"])


def missing_row_sql(column: str) -> str:
    """Report line of a column's missing share, only where values are missing."""
    pct = f"round(100.0 * CAST(count(*) - count({column}) AS DOUBLE) / count(*), 2)"
    mark = f"CASE WHEN {pct} < 5 THEN '✓' WHEN {pct} < 20 THEN '⚠' ELSE '✗' END"
    return f"SELECT 'Missing: {column}', format('{{:.2f}}%', {pct}), {mark} FROM wide HAVING {pct} > 0"


@query(f"""WITH {WIDE}, g AS (SELECT h, date_diff('microsecond', lag(h) OVER (ORDER BY h), h) / 3.6e9 AS gap FROM wide)
SELECT 'Total Rows' AS metric, format('{{:,}}', count(*)) AS value, CASE WHEN count(*) > 0 THEN '✓' ELSE '✗' END AS status FROM wide
UNION ALL SELECT * FROM (VALUES ('Total Columns', '3', '✓'), ('Timezone Aware', 'No', '⚠'),
  ('Dtype: ts', 'timestamp_ntz', 'ℹ'), ('Dtype: pm25', 'double', 'ℹ'), ('Dtype: pm10', 'double', 'ℹ'))
UNION ALL SELECT 'Date Range Start', CAST(min(h) AS VARCHAR), '✓' FROM wide
UNION ALL SELECT 'Date Range End', CAST(max(h) AS VARCHAR), '✓' FROM wide
UNION ALL SELECT 'Time Span (days)', format('{{:.1f}}', date_diff('microsecond', min(h), max(h)) / 86400e6), '✓' FROM wide
UNION ALL SELECT 'Median Timestep (hours)', format('{{:.2f}}', median(gap)), CASE WHEN median(gap) > 0 THEN '✓' ELSE '✗' END FROM g
UNION ALL SELECT 'Duplicate Timestamps', format('{{:,}}', count(*) - count(DISTINCT h)),
  CASE WHEN count(*) = count(DISTINCT h) THEN '✓' ELSE '⚠' END FROM wide
UNION ALL {missing_row_sql('pm25')} UNION ALL {missing_row_sql('pm10')}""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = inputs.wide(spark, sf_dir).select(hour_ts(), "pm25", "pm10")
    return profile.audit_report(hourly, ["pm25", "pm10"])


@query("SELECT o_custkey AS custkey, count(*) - count(DISTINCT o_orderdate) AS n_duplicates FROM orders GROUP BY ALL")
def duplicate_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("ts")
    )
    return profile.duplicate_timestamps(rows, keys=["custkey"])


@query(f"""WITH {WIDE}, d AS ({union_sql('''SELECT '$c' AS "column", count($c) AS "count", avg($c) AS mean,
  stddev_samp($c) AS std, min($c) AS min, quantile_cont($c, 0.25) AS q25, median($c) AS median,
  quantile_cont($c, 0.75) AS q75, max($c) AS max FROM wide''', inputs.WIDE_COLUMNS)})
SELECT "column", "count", round(mean, 6) AS mean, round(std, 6) AS std, min, round(q25, 6) AS q25,
       round(median, 6) AS median, round(q75, 6) AS q75, max FROM d""")
def describe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = profile.describe(inputs.wide(spark, sf_dir), inputs.WIDE_COLUMNS)
    return rounded(summary, ["mean", "std", "q25", "median", "q75"])


@query(f"""WITH {ORDERS}, p AS ({union_sql('''SELECT '$c' AS "column", count(*) AS n_rows,
  count(*) - count($c) AS n_missing FROM os''', ['id', 'ts', 'value', 'pm25', 'pm10'])})
SELECT "column", CASE "column" WHEN 'id' THEN 'bigint' WHEN 'ts' THEN 'timestamp_ntz' ELSE 'double' END AS dtype,
       n_rows, n_missing, round(100.0 * CAST(n_missing AS DOUBLE) / n_rows, 6) AS pct_missing FROM p""")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.table_profile(inputs.order_series(spark, sf_dir)), ["pct_missing"])


@query(f"""WITH {WIDE}, p AS ({union_sql('''SELECT '$c' AS "column", count($c) AS n_valid,
  count(*) - count($c) AS n_missing, 100.0 * CAST(count($c) AS DOUBLE) / count(*) AS p FROM wide''', inputs.WIDE_COLUMNS)})
SELECT "column", n_valid, n_missing, round(p, 6) AS pct_present FROM p""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.completeness(inputs.wide(spark, sf_dir), inputs.WIDE_COLUMNS), ["pct_present"])


@query(f"""WITH {SERIES}, r AS (SELECT parameter, {roll_sql('value', 'mean', 24, 24, 'm', 'PARTITION BY parameter', lagged=False)}
  FROM series)
SELECT parameter, count(m) AS n_windows, CASE parameter WHEN 'pm25' THEN count(CASE WHEN m > 15 THEN 1 END)
  WHEN 'pm10' THEN count(CASE WHEN m > 45 THEN 1 END) END AS n_exceeding FROM r GROUP BY parameter""")
def exceedance_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = rolling("m", "value", "mean", 24, lagged=False)
    means = add_features(inputs.series(spark, sf_dir), [day], ["parameter"])
    limit = reports.guideline_of("parameter", "daily")
    counts = means.withColumn("limit", limit).groupBy("parameter", "limit").agg(
        F.count("m").alias("n_windows"), F.count_if(steady("m") > F.col("limit")).alias("_over")
    )
    return counts.select("parameter", "n_windows", F.when(F.col("limit").isNotNull(), F.col("_over")).alias("n_exceeding"))


EXTREMES = f"""{ORDERS}, q AS (SELECT quantile_cont(value, 0.99) AS t FROM os),
ext AS (SELECT id, ts, value, t FROM os, q WHERE value >= t)"""


@query(f"WITH {EXTREMES} SELECT id, ts, value, round(t, 6) AS threshold FROM ext")
def extreme_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.order_series(spark, sf_dir).select("id", "ts", "value")
    return rounded(distribution.upper_extremes(rows, "value"), ["threshold"])


@query(f"WITH {ORDERS} SELECT id, ts, value FROM os ORDER BY value DESC, ts, id LIMIT 10")
def extremes_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.order_series(spark, sf_dir).select("id", "ts", "value")
    return distribution.top_rows(rows, "value", ["ts", "id"], 10)


@query(f"WITH {EXTREMES} SELECT CAST(month(ts) AS INTEGER) AS month, count(*) AS n_events FROM ext GROUP BY ALL")
def extremes_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.order_series(spark, sf_dir).select("id", "ts", "value")
    return distribution.extremes_by_month(distribution.upper_extremes(rows, "value"))


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for a in LINE_COLUMNS for b in LINE_COLUMNS
))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distribution.correlation_matrix(inputs.table(spark, sf_dir, "lineitem"), LINE_COLUMNS), ["r"])


@query("""WITH f AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
  regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
  min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
SELECT n, round(slope, 4) AS slope, round(intercept, 3) AS intercept, round(r2, 6) AS r2, x_min, x_max,
       round(slope * x_min + intercept, 3) AS y_at_min, round(slope * x_max + intercept, 3) AS y_at_max FROM f""")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = distribution.linear_fit(inputs.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    fit = rounded(rounded(fit, ["slope"], 4), ["intercept", "y_at_min", "y_at_max"], 3)
    return rounded(fit, ["r2"])


@query(f"""WITH v AS ({union_sql('SELECT \'$c\' AS "column", $c AS v FROM lineitem WHERE $c IS NOT NULL', LINE_COLUMNS)}),
e AS (SELECT "column", min(v) AS lo, max(v) AS hi FROM v GROUP BY ALL),
g AS (SELECT v."column", v, lo, (hi - lo) / 30.0 AS w, CAST(least(floor((v - lo) / (hi - lo) * 30.0), 29) AS INTEGER) AS b
      FROM v JOIN e ON e."column" = v."column"),
c AS (SELECT "column", CASE WHEN v < lo + b * w THEN b - 1 WHEN b < 29 AND v >= lo + (b + 1) * w THEN b + 1 ELSE b END AS bin,
             count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT "column", lo, (hi - lo) / 30.0 AS w, unnest(generate_series(0, 29)) AS bin FROM e)
SELECT b."column", CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 6) AS "left", round(lo + (b.bin + 1) * w, 6) AS "right",
       coalesce(n, 0) AS "count" FROM b LEFT JOIN c ON c."column" = b."column" AND c.bin = b.bin""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        distribution.histogram(inputs.table(spark, sf_dir, "lineitem"), LINE_COLUMNS, 30), ["left", "right"]
    )


BOX_SQL = f"""WITH v AS ({union_sql('SELECT \'$c\' AS "column", $c AS v FROM lineitem WHERE $c IS NOT NULL', LINE_COLUMNS)}),
q AS (SELECT "column", count(*) AS n, CAST(sum(CAST(v AS DECIMAL(24,2))) AS DOUBLE) / count(*) AS mean,
  quantile_cont(v, 0.25) AS q25, median(v) AS median, quantile_cont(v, 0.75) AS q75 FROM v GROUP BY ALL),
b AS (SELECT q.*, q75 - q25 AS iqr,
  (SELECT min(v) FROM v WHERE v."column" = q."column" AND v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS low,
  (SELECT max(v) FROM v WHERE v."column" = q."column" AND v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS high,
  (SELECT count(*) FROM v WHERE v."column" = q."column" AND NOT v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS n_outliers
  FROM q)
SELECT "column", n, round(mean, 4) AS mean, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75,
       round(least(low, q25), 6) AS whisker_low, round(greatest(high, q75), 6) AS whisker_high, n_outliers,
       round(median - 1.57 * iqr / sqrt(n), 6) AS notch_low, round(median + 1.57 * iqr / sqrt(n), 6) AS notch_high FROM b"""


@query(BOX_SQL)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = distribution.box_stats(inputs.table(spark, sf_dir, "lineitem"), LINE_COLUMNS)
    stats = rounded(stats, ["q25", "median", "q75", "whisker_low", "whisker_high", "notch_low", "notch_high"])
    return rounded(stats, ["mean"], 4)


def _horner_sql(x: str, coefficients: list[float]) -> str:
    text = repr(coefficients[-1]) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * ({x}) + {c!r}::DOUBLE)"
    return text


QQ = f"""WITH o AS (SELECT value, row_number() OVER (ORDER BY value) AS rank, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT *, CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n)
                     ELSE (CAST(rank AS DOUBLE) - 0.3175) / (CAST(n AS DOUBLE) + 0.365) END AS p FROM o),
r AS (SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM p),
t AS (SELECT rank, value, CASE WHEN abs(q) <= 0.425
    THEN q * {_horner_sql('0.180625 - q * q', CENTRAL_NUM)} / {_horner_sql('0.180625 - q * q', CENTRAL_DEN)}
    WHEN r <= 5 THEN sign(q) * {_horner_sql('r - 1.6', MIDDLE_NUM)} / {_horner_sql('r - 1.6', MIDDLE_DEN)}
    ELSE sign(q) * {_horner_sql('r - 5.0', FAR_NUM)} / {_horner_sql('r - 5.0', FAR_DEN)} END AS z FROM r)"""


@query(f"{QQ} SELECT rank, round(z, 6) AS theoretical, value AS ordered FROM t")
def qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = distribution.qq_points(inputs.table(spark, sf_dir, "events"), "value")
    return rounded(points, ["theoretical"])


@query(f"""{QQ} SELECT count(*) AS n, round(regr_slope(value, z), 4) AS slope, round(regr_intercept(value, z), 4) AS intercept,
       round(corr(value, z), 6) AS r FROM t""")
def qq_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = distribution.qq_line(distribution.qq_points(inputs.table(spark, sf_dir, "events"), "value"))
    return rounded(rounded(line, ["slope", "intercept"], 4), ["r"])


def _guideline_sql(parameter: str, daily: float, annual: float) -> str:
    return f"""SELECT h AS ts, '{parameter}' AS parameter, {parameter} AS value, {daily}::DOUBLE AS guideline_daily,
  {annual}::DOUBLE AS guideline_annual, CASE WHEN {parameter} > {daily} THEN 'above_daily'
  WHEN {parameter} > {annual} THEN 'above_annual' WHEN {parameter} IS NOT NULL THEN 'within' END AS status FROM wide"""


@query(f"WITH {WIDE} {_guideline_sql('pm25', 15.0, 5.0)} UNION ALL {_guideline_sql('pm10', 45.0, 15.0)}")
def series_with_guidelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = inputs.wide(spark, sf_dir)
    parts = [
        reports.with_guidelines(grid.select(hour_ts(), F.lit(p).alias("parameter"), F.col(p).alias("value")), p, "value")
        for p in GUIDELINES
    ]
    return reduce(DataFrame.unionByName, parts)
