"""Correlation, regression, histograms, box-plot statistics, extremes and Q-Q points."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.functions.distributions import normal_quantile
from hourloom.operators.moments import pair_sums
from hourloom.operators.ranks import EARLIER, even_scale, exact_quantiles, quantile_columns, value_counts

BUILT_IN = 20  # columns whose correlations are built-in aggregates
QUARTILES = {0.25: "q25", 0.5: "median", 0.75: "q75"}


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair, each over its own complete rows, in one pass.

    Beyond BUILT_IN columns the pairs are too many for one generated aggregate; sums of products of
    blocks of rows take their place, and only columns squared numbers leave a task.
    """
    columns = list(columns)
    if len(columns) > BUILT_IN:
        found = pair_sums(df, columns).correlation()
        rows = [
            (a, b, None if np.isnan(found[i, j]) else float(found[i, j]))
            for i, a in enumerate(columns)
            for j, b in enumerate(columns)
        ]
        return df.sparkSession.createDataFrame(rows, "x string, y string, r double")
    cells = []
    for a, b in combinations_with_replacement(columns, 2):
        # corr(a, a) keeps the built-in treatment of constant and empty columns
        value = F.corr(a, b)
        cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), value.alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), value.alias("r")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x with its r-squared and the two ends of the fitted line."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
    )
    ends = {"y_at_min": F.col("x_min"), "y_at_max": F.col("x_max")}
    return fit.withColumns({name: F.col("slope") * x_end + F.col("intercept") for name, x_end in ends.items()})


def histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width histogram per column: the last bin includes the maximum, empty bins are kept.

    Bin limits come from a one-row aggregate of the same columns.
    """
    limits = df.agg(
        F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).alias("s")
    )
    cells = []
    for c in columns:
        lo, hi = F.col(f"s.{c}.lo"), F.col(f"s.{c}.hi")
        cells.append(F.struct(F.lit(c).alias("column"), lo.alias("lo"), hi.alias("hi")))
    edges = limits.select(F.inline(F.array(*cells))).where(F.col("lo").isNotNull())
    # a constant column is spread over one unit around its value
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(
        "column",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    ).where(F.col("v").isNotNull())
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins)))
    first_guess = F.least(place, F.lit(bins - 1)).cast("int")

    def edge(index: Column) -> Column:
        return F.col("lo") + index * width

    # the division can land one bin off at an edge; the printed edges decide
    b = F.col("_b")
    settled = (
        F.when(F.col("v") < edge(b), b - 1)
        .when((b < bins - 1) & (F.col("v") >= edge(b + 1)), b + 1)
        .otherwise(b)
    )
    counted = (
        long.join(F.broadcast(edges), "column")  # one row per requested column
        .withColumn("_b", first_guess)
        .groupBy("column", settled.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = edges.select("column", "lo", width.alias("width"), F.explode(F.array(*[F.lit(i) for i in range(bins)])).alias("bin"))
    return frame.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("right"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, mean, whiskers at 1.5 interquartile ranges, outlier count and median notch."""
    quartiles = quantile_columns(exact_quantiles(df, columns, list(QUARTILES)), QUARTILES)
    fences = quartiles.withColumn("iqr", F.col("q75") - F.col("q25"))
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull() & ~F.isnan("value"))
    v = F.col("value")
    inside = v.between(F.col("q25") - 1.5 * F.col("iqr"), F.col("q75") + 1.5 * F.col("iqr"))
    # one pass that is summed inside each task; values themselves are not shuffled
    reach = (
        long.join(F.broadcast(fences), "column")  # one row per requested column
        .groupBy("column", "q25", "median", "q75", "iqr")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(v).alias("mean"),
            F.min(F.when(inside, v)).alias("low"),
            F.max(F.when(inside, v)).alias("high"),
            F.count(F.when(~inside, 1)).alias("n_outliers"),
        )
    )
    notch = 1.57 * F.col("iqr") / F.sqrt(F.col("n").cast("double"))
    return reach.select(
        "column",
        "n",
        "mean",
        "q25",
        "median",
        "q75",
        F.least("low", "q25").alias("whisker_low"),
        F.greatest("high", "q75").alias("whisker_high"),
        "n_outliers",
        (F.col("median") - notch).alias("notch_low"),
        (F.col("median") + notch).alias("notch_high"),
    )


def upper_extremes(df: DataFrame, value: str, prob: float = 0.99) -> DataFrame:
    """Rows at or above an exact quantile, with the threshold."""
    cut = exact_quantiles(df, [value], [prob]).select("quantile").scalar()
    return df.withColumn("threshold", cut).where(F.col(value) >= F.col("threshold"))


def top_rows(df: DataFrame, value: str, ties: Sequence[str], k: int = 10) -> DataFrame:
    """The k largest values; each task keeps k rows, nothing is sorted globally."""
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value), *ties).limit(k)


def extremes_by_month(extremes: DataFrame, ts: str = "ts") -> DataFrame:
    return extremes.groupBy(F.month(ts).alias("month")).agg(F.count(F.lit(1)).alias("n_events"))


def filliben_position(rank: Column, n: Column) -> Column:
    """Uniform order-statistic median of the 1-based rank."""
    half = F.lit(0.5)
    edge = F.pow(half, F.lit(1.0) / n)
    return F.when(rank == n, edge).when(rank == 1, 1.0 - edge).otherwise((rank - 0.3175) / (n + 0.365))


def qq_points(df: DataFrame, value: str, bins: int = 4096, chunk: int = 100_000) -> DataFrame:
    """Ordered values against normal quantiles, one row per observation, with the fitted line.

    Distinct values are ranked through value bins; a value held by many rows is one row until its
    copies are expanded again in bounded chunks spread over the cluster.
    """
    counts = value_counts(df, [value]).select("value", "_c")
    span = F.col("_span")
    limits = counts.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
    low, high = even_scale(span["lo"]), even_scale(span["hi"])
    share = (even_scale(F.col("value")) - low) / F.nullif(high - low, F.lit(0.0)) * F.lit(float(bins))
    place = F.when(F.col("value") <= span["lo"], F.lit(0.0)).otherwise(share)
    binned = counts.withColumn("_span", limits).withColumn(
        "_bin", F.coalesce(F.least(F.floor(place), F.lit(bins - 1)), F.lit(0).cast("bigint"))
    ).drop("_span")
    ranked = weighted_rank(binned, "value", "_c", "_bin")
    chunks = ranked.select(
        "value",
        "n",
        F.explode(F.sequence(F.col("rank0"), F.col("rank0") + F.col("_c") - 1, F.lit(chunk).cast("bigint"))).alias("from"),
        (F.col("rank0") + F.col("_c") - 1).alias("last"),
    ).repartition("from")
    points = chunks.select(
        "value",
        "n",
        F.explode(F.sequence(F.col("from"), F.least(F.col("last"), F.col("from") + chunk - 1))).alias("rank0"),
    )
    rank = (F.col("rank0") + 1).cast("double")
    return points.select(
        (F.col("rank0") + 1).alias("rank"),
        normal_quantile(filliben_position(rank, F.col("n").cast("double"))).alias("theoretical"),
        F.col("value").alias("ordered"),
    )


def weighted_rank(df: DataFrame, value: str, weight: str, bucket: str) -> DataFrame:
    """0-based first rank of each distinct value (rank0) and the total count (n).

    The only window without keys runs over the table of bucket sizes, one row per bucket.
    """
    sizes = df.groupBy(bucket).agg(F.sum(weight).alias("_size"))
    along = W.orderBy(bucket)
    before = F.coalesce(F.sum("_size").over(along.rowsBetween(*EARLIER)), F.lit(0))
    placed = sizes.select(bucket, before.alias("_before"), F.sum("_size").over(W.partitionBy(F.lit(0))).alias("n"))
    inside = W.partitionBy(bucket).orderBy(value)
    passed = F.coalesce(F.sum(weight).over(inside.rowsBetween(*EARLIER)), F.lit(0))
    return df.join(placed, bucket).select(value, weight, "n", (F.col("_before") + passed).alias("rank0"))


def qq_line(points: DataFrame) -> DataFrame:
    """Least-squares line through the Q-Q points and their correlation."""
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.corr("ordered", "theoretical").alias("r"),
    )

