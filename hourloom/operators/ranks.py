"""Exact global ranks, gaps and quantiles without sending an ordered set through one task.

All of them follow one pattern: rows are bucketed by something that never decreases along the
order, buckets are counted with map-side combine, the small bucket table is accumulated, and only
the rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.functions.timecols import MINUTE_US, epoch_micros, floor_div

EARLIER = (W.unboundedPreceding, -1)


def distributed_rank(
    df: DataFrame,
    order: Sequence[str],
    buckets: Sequence[tuple[str, Column]],
    keys: Sequence[str] = (),
    rank: str = "seq",
    total: str = "n_rows",
) -> DataFrame:
    """0-based row number by `order` within keys, plus the row count of each key.

    buckets are (name, column) pairs that never decrease along the order, most significant first.
    The table of bucket counts is what gets accumulated per key, and one bucket is sorted in one
    task, so both must be bounded: days of an hourly series, value bins. For raw rows, where one
    hour or one instant may hold a large share of the table, use sorted_rank.
    """
    names = [n for n, _ in buckets]
    marked = df.withColumns(dict(buckets))
    counts = marked.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_c"))
    along = W.partitionBy(*keys).orderBy(*names)
    offsets = counts.select(
        *keys,
        *names,
        F.coalesce(F.sum("_c").over(along.rowsBetween(*EARLIER)), F.lit(0)).alias("_before"),
        F.sum("_c").over(W.partitionBy(*keys)).alias(total),
    )
    inside = W.partitionBy(*keys, *names).orderBy(*order)
    return (
        marked.join(offsets, [*keys, *names])
        .withColumn(rank, F.row_number().over(inside) - 1 + F.col("_before"))
        .drop(*names, "_before")
    )


def sorted_rank(
    df: DataFrame, order: Sequence[str], rank: str = "seq", total: str = "n_rows"
) -> DataFrame:
    """0-based global row number by a unique order, whatever the skew.

    One range-partitioned sort: its sampled bounds include the last order column, so even rows that
    share an instant are split over tasks. The sorted rows are persisted, which fixes their
    partitions; only the row count of each partition comes to the driver.
    """
    ordered = df.orderBy(*order).persist(StorageLevel.MEMORY_AND_DISK)
    position = F.monotonically_increasing_id()  # the upper bits hold the partition number
    marked = ordered.withColumn("_position", position).withColumn("_part", F.shiftright("_position", 33))
    starts, n = [], 0
    for row in marked.groupBy("_part").agg(F.count(F.lit(1)).alias("size")).orderBy("_part").collect():
        starts.append((row["_part"], n))
        n += row["size"]
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    within = F.col("_position") - F.shiftleft("_part", 33)
    return (
        marked.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumns({rank: within + F.col("_start"), total: F.lit(n).cast("bigint")})
        .drop("_part", "_position", "_start")
    )


def consecutive_gaps(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Gaps in microseconds between neighbouring timestamps of each key, as (gap_us, weight).

    Repeated timestamps are collapsed first and come back as zero gaps with a weight, so a
    timestamp shared by many rows costs one row. Within a minute the previous timestamp is found by
    a window on (key, minute); the first one of a minute looks at the last one of the previous
    non-empty minute, in a table with at most one row per key and calendar minute. A busy key or
    minute is thus bounded by its distinct instants, not by its rows.
    """
    instants = (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, epoch_micros(ts).alias("_us"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_minute", floor_div(F.col("_us"), MINUTE_US))
    )
    inside = W.partitionBy(*keys, "_minute").orderBy("_us")
    linked = instants.select(
        *keys,
        "_minute",
        "_us",
        "_c",
        F.lag("_us").over(inside).alias("_prev"),
        F.max("_us").over(W.partitionBy(*keys, "_minute")).alias("_last"),
    )
    across = W.partitionBy(*keys).orderBy("_minute")
    firsts = linked.where(F.col("_prev").isNull()).withColumn("_prev", F.lag("_last").over(across))
    pairs = F.array(
        F.struct((F.col("_us") - F.col("_prev")).alias("gap_us"), F.lit(1).cast("bigint").alias("weight")),
        F.struct(F.lit(0).cast("bigint").alias("gap_us"), (F.col("_c") - 1).alias("weight")),
    )
    links = linked.where(F.col("_prev").isNotNull()).unionByName(firsts)
    return links.select(*keys, F.inline(pairs)).where(
        F.col("gap_us").isNotNull() & (F.col("weight") > 0)
    )


def _long_values(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], weight: str | None
) -> DataFrame:
    """(keys, column, value, _c) with one row per non-null value."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    size = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    return df.select(*keys, size.alias("_c"), F.inline(F.array(*cells))).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def value_counts(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """(keys, column, value, _c): how often each distinct non-null value of each column occurs."""
    return _long_values(df, columns, keys, weight).groupBy(*keys, "column", "value").agg(F.sum("_c").alias("_c"))


def _positions(n: Column, prob: float) -> tuple[Column, Column, Column]:
    """Linear-interpolation position: lower rank, upper rank, fraction."""
    at = (n - 1) * F.lit(prob)
    low = F.floor(at)
    return low, F.least(low + 1, n - 1), at - low


def _holds_rank(start: Column, size: Column, ranks: Column) -> Column:
    return F.exists(ranks, lambda r: (r >= start) & (r < start + size))


def even_scale(value: Column) -> Column:
    """A never decreasing scale on which far outliers do not push all other values into one bin."""
    return F.signum(value) * F.log1p(F.abs(value))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    weight: str | None = None,
    bins: int = 4096,
    reread: bool | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles: rows of (keys, column, prob, quantile, n_values).

    The built-in exact percentile gathers every distinct value of a group in one task. Here a
    histogram finds the bins that hold the wanted ranks, a finer histogram narrows them down, and
    only the distinct values left are sorted. Bins are even on a logarithmic scale, so heavy tails leave
    them filled. Bins steer the work and never the answer: any distribution gives the exact quantile.

    Two ways to feed the histograms, chosen by reread:
    True reads the input three times and shuffles only bin counts and the values of chosen bins;
    right for stored tables, and the default without keys and weights.
    False reads it once and shuffles the distinct values with their counts; right for derived
    input and for any number of keys.
    """
    if reread is None:
        reread = not keys and weight is None
    if reread and keys:
        raise ValueError("rereading needs a known number of groups: leave out the keys")
    group = [*keys, "column"]
    source = _long_values(df, columns, keys, weight) if reread else value_counts(df, columns, keys, weight)

    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    # the sum keeps the limits on the counted values, whose exchange is then reused
    limits = source.groupBy("column").agg(
        F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.sum("_c").alias("n")
    )
    entry = F.struct("column", F.struct("lo", "hi", "n"))
    spans = limits.agg(F.map_from_entries(F.collect_list(entry))).scalar()  # one entry per column
    span = F.col("_span")
    zero = F.lit(0).cast("bigint")  # keeps the bins NOT NULL, so no null filter splits the shared scan
    low, high = even_scale(span["lo"]), even_scale(span["hi"])
    share = (even_scale(F.col("value")) - low) / F.nullif(high - low, F.lit(0.0)) * F.lit(float(bins))
    share = F.when(F.col("value") <= span["lo"], 0.0).when(F.col("value") >= span["hi"], float(bins)).otherwise(share)
    rows = (
        source.withColumn("_span", F.element_at(spans, F.col("column")))
        .withColumn("_x", F.coalesce(share, F.lit(0.0)))
        .withColumn("_d0", F.coalesce(F.least(F.floor("_x"), F.lit(bins - 1)), zero))
        .withColumn("_d1", F.coalesce(F.least(F.floor((F.col("_x") - F.col("_d0")) * F.lit(float(bins))), F.lit(bins - 1)), zero))
        .drop("_x", "_span")
    )

    by_key = W.partitionBy(*group)
    top = (
        rows.groupBy(*group, "_d0")
        .agg(F.sum("_c").alias("_size"))
        .select(
            *group,
            "_d0",
            "_size",
            F.coalesce(F.sum("_size").over(by_key.orderBy("_d0").rowsBetween(*EARLIER)), F.lit(0)).alias("_start"),
            F.sum("_size").over(by_key).alias("_n"),
        )
    )
    ranks = F.array(*[r for p in probs for r in _positions(F.col("_n"), p)[:2]])
    top = top.where(_holds_rank(F.col("_start"), F.col("_size"), ranks)).drop("_size")
    if reread:
        # at most two chosen bins per column and probability
        kept = rows.join(F.broadcast(top), [*group, "_d0"])
        kept = kept.groupBy(*group, "_d0", "_d1", "_start", "_n", "value").agg(F.sum("_c").alias("_c"))
    else:
        kept = rows.join(top, [*group, "_d0"])

    within = W.partitionBy(*group, "_d0").orderBy("_d1")
    before = F.coalesce(F.sum("_size").over(within.rowsBetween(*EARLIER)), F.lit(0))
    chosen = (
        kept.groupBy(*group, "_d0", "_d1", "_start", "_n")
        .agg(F.sum("_c").alias("_size"))
        .withColumn("_from", F.col("_start") + before)
        .where(_holds_rank(F.col("_from"), F.col("_size"), ranks))
        .select(*group, "_d0", "_d1", "_from")
    )

    inside = W.partitionBy(*group, "_d0", "_d1").orderBy("value")
    passed = F.coalesce(F.sum("_c").over(inside.rowsBetween(*EARLIER)), F.lit(0))
    located = kept.join(chosen, [*group, "_d0", "_d1"]).select(
        *group, "value", "_c", "_n", (F.col("_from") + passed).alias("_rank")
    )
    ends = []
    for p in probs:
        for side, rank in zip(("low", "high"), _positions(F.col("_n"), p)):
            held = (rank >= F.col("_rank")) & (rank < F.col("_rank") + F.col("_c"))
            ends.append(F.when(held, F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"))))
    hits = located.select(*group, "value", "_n", F.inline(F.array_compact(F.array(*ends))))
    at = (F.col("_n") - 1) * F.col("prob")
    return (
        hits.groupBy(*group, "prob", "_n")
        .agg(
            F.max(F.when(F.col("side") == "low", F.col("value"))).alias("_low"),
            F.max(F.when(F.col("side") == "high", F.col("value"))).alias("_high"),
        )
        .select(
            *group,
            "prob",
            (F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))).alias("quantile"),
            F.col("_n").alias("n_values"),
        )
    )


def quantile_columns(
    quantiles: DataFrame, names: dict[float, str], keys: Sequence[str] = ("column",)
) -> DataFrame:
    """Turn quantile rows into one row per key with a named column per probability."""
    return quantiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()]
    )
