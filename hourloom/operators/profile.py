"""Audits, coverage tables, calendar profiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.numeric import mean, share_missing, share_present
from hourloom.functions.timecols import epoch_micros
from hourloom.operators.clean import median_gap
from hourloom.operators.grid import dense_profile
from hourloom.operators.ranks import exact_quantiles, quantile_columns

QUARTILES = {0.25: "q25", 0.5: "median", 0.75: "q75"}


def bucket_profile(
    df: DataFrame,
    bucket: Column,
    name: str,
    value: str = "value",
    keys: Sequence[str] = (),
    scale: int | None = None,
) -> DataFrame:
    """Mean, sample deviation and count of a value per calendar bucket."""
    return df.groupBy(*keys, bucket.alias(name)).agg(
        mean(value, scale).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.count(value).alias("count"),
    )


def hour_profile(df: DataFrame, ts: str = "ts", **options) -> DataFrame:
    return bucket_profile(df, F.hour(ts), "hour", **options)


def weekday_profile(df: DataFrame, ts: str = "ts", **options) -> DataFrame:
    """Monday is 0."""
    return bucket_profile(df, F.weekday(ts), "day_of_week", **options)


def month_profile(df: DataFrame, ts: str = "ts", **options) -> DataFrame:
    return bucket_profile(df, F.month(ts), "month", **options)


def extreme_bucket(profile: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Peak and lowest bucket per key, the first bucket winning ties.

    A profile holds a few dozen rows per key; min and max of (mean, bucket) pick both ends in one
    aggregation without a sort.
    """
    known = profile.where(F.col("mean").isNotNull())
    top = F.min(F.struct((-F.col("mean")).alias("m"), F.col(name).alias("b")))
    low = F.min(F.struct(F.col("mean").alias("m"), F.col(name).alias("b")))
    return known.groupBy(*keys).agg(top.alias("top"), low.alias("low")).select(
        *keys,
        F.col("top.b").alias(f"peak_{name}"),
        (-F.col("top.m")).alias("peak_mean"),
        F.col("low.b").alias(f"lowest_{name}"),
        F.col("low.m").alias("lowest_mean"),
    )


def daily_mean(
    df: DataFrame, ts: str = "ts", value: str = "value", keys: Sequence[str] = (), scale: int | None = None
) -> DataFrame:
    present = df.where(F.col(value).isNotNull())
    return present.groupBy(*keys, F.to_date(ts).alias("date")).agg(mean(value, scale).alias("mean"))


def annual_mean(
    df: DataFrame, ts: str = "ts", value: str = "value", keys: Sequence[str] = (), scale: int | None = None
) -> DataFrame:
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(mean(value, scale).alias("mean"))


def season_matrix(
    df: DataFrame, ts: str = "ts", value: str = "value", scale: int | None = None
) -> DataFrame:
    """Hour by month means, one row per hour and one column per month, empty cells NULL."""
    present = df.where(F.col(value).isNotNull())
    month = F.month(ts)
    cells = [mean(F.when(month == m, F.col(value)), scale).alias(f"m{m}") for m in range(1, 13)]
    by_hour = present.groupBy(F.hour(ts).alias("hour")).agg(*cells)
    return dense_profile(by_hour, {"hour": range(24)})


def monthly_coverage(
    df: DataFrame, columns: Sequence[str], ts: str = "ts", keys: Sequence[str] = ()
) -> DataFrame:
    """Rows and missing percentage per calendar month, for the columns the table has."""
    shares = [share_missing(c).alias(f"{c}_missing_pct") for c in columns if c in df.columns]
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, F.date_format(ts, "yyyy-MM").alias("year_month"))
        .agg(F.count(F.lit(1)).alias("n_rows"), *shares)
    )


def duplicate_timestamps(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """How many rows repeat an earlier row's timestamp; NULLs count as one timestamp."""
    per_instant = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_c"))
    return per_instant.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("n_duplicates")
    )


def missing_status(pct: Column) -> Column:
    """Fixed status marks: below 5 percent, below 20 percent, above."""
    return F.when(pct < 5, "✓").when(pct < 20, "⚠").otherwise("✗")


def series_audit(
    df: DataFrame, columns: Sequence[str], ts: str = "ts", keys: Sequence[str] = ()
) -> DataFrame:
    """Numeric audit of each series: size, range, span, step, duplicates, missing rates."""
    shares = [F.round(share_missing(c), 2).alias(f"{c}_missing_pct") for c in columns]
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *shares,
    )
    span_us = epoch_micros("last_ts") - epoch_micros("first_ts")
    audit = base.withColumn("span_days", span_us / F.lit(86_400e6))
    audit = audit.withColumns({f"{c}_status": missing_status(F.col(f"{c}_missing_pct")) for c in columns})
    duplicates = duplicate_timestamps(df, ts, keys)
    steps = median_gap(df, keys, ts).drop("n_gaps")
    if keys:
        return audit.join(duplicates, list(keys), "left").join(steps, list(keys), "left")
    return audit.withColumn("n_duplicates", duplicates.scalar()).withColumn("median_hours", steps.scalar())


def audit_report(df: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """The audit of one table as (metric, value, status) rows, text formatted for reading."""
    audit = series_audit(df, columns, ts)
    rows = [
        ("Total Rows", F.format_number("n_rows", 0), F.when(F.col("n_rows") > 0, "✓").otherwise("✗")),
        ("Total Columns", F.lit(str(len(df.columns))), F.lit("✓")),
        (
            "Timezone Aware",
            F.lit("Yes" if dict(df.dtypes)[ts] == "timestamp" else "No"),
            F.lit("✓" if dict(df.dtypes)[ts] == "timestamp" else "⚠"),
        ),
        ("Date Range Start", F.col("first_ts").cast("string"), F.lit("✓")),
        ("Date Range End", F.col("last_ts").cast("string"), F.lit("✓")),
        ("Time Span (days)", F.format_string("%.1f", "span_days"), F.lit("✓")),
        (
            "Median Timestep (hours)",
            F.format_string("%.2f", "median_hours"),
            F.when(F.col("median_hours") > 0, "✓").otherwise("✗"),
        ),
        (
            "Duplicate Timestamps",
            F.format_number("n_duplicates", 0),
            F.when(F.col("n_duplicates") == 0, "✓").otherwise("⚠"),
        ),
    ]
    cells = [F.struct(F.lit(m).alias("metric"), v.alias("value"), s.alias("status")) for m, v, s in rows]
    for c in columns:
        pct = F.col(f"{c}_missing_pct")
        cell = F.struct(
            F.lit(f"Missing: {c}").alias("metric"),
            F.format_string("%.2f%%", pct).alias("value"),
            F.col(f"{c}_status").alias("status"),
        )
        cells.append(F.when(pct > 0, cell))
    for f in df.schema:
        cells.append(
            F.struct(
                F.lit(f"Dtype: {f.name}").alias("metric"),
                F.lit(f.dataType.simpleString()).alias("value"),
                F.lit("ℹ").alias("status"),
            )
        )
    return audit.select(F.inline(F.array_compact(F.array(*cells))))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum per column."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        )
        for c in columns
    ]
    moments = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    quartiles = quantile_columns(exact_quantiles(df, columns, list(QUARTILES)), QUARTILES)
    return moments.join(quartiles, "column", "left")


def table_profile(df: DataFrame) -> DataFrame:
    """Type, missing count and missing rate of every column, with the row count, in one pass."""
    n = F.count(F.lit(1))
    cells = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            n.alias("n_rows"),
            (n - F.count(f.name)).alias("n_missing"),
            share_missing(f.name).alias("pct_missing"),
        )
        for f in df.schema
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def completeness(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Valid and missing counts and the present percentage per column."""
    n = F.count(F.lit(1))
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n_valid"),
            (n - F.count(c)).alias("n_missing"),
            share_present(c).alias("pct_present"),
        )
        for c in columns
    ]
    return df.groupBy(*keys).agg(F.array(*cells).alias("cells")).select(*keys, F.inline("cells"))


def group_completeness(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Number of columns per feature group and their mean present percentage, in one pass."""
    cells = [
        F.struct(F.lit(g).alias("feature_group"), share_present(c).alias("p"))
        for g, columns in groups.items()
        for c in columns
    ]
    rows = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return rows.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("n_features"), F.avg("p").alias("mean_pct_present")
    )
