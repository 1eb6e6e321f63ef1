"""Gapless ranks in a seeded order without sorting a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, seed: int = 0, buckets: int = 1024
) -> DataFrame:
    """0-based rank within the keys (no nulls), in the order of a seeded hash of the order columns.

    The hash cuts every group into buckets; bucket counts are summed map-side and accumulated, and
    only one bucket of one group is sorted in a task. Rows equal in all order columns are alike, so
    which of them gets which rank does not matter.
    """
    marked = df.withColumn("_h", F.xxhash64(F.lit(seed), *order)).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    counts = marked.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    along = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_b", F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_b").orderBy("_h", *order)
    ranked = marked.join(starts, [*keys, "_b"]).withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
    return ranked.drop("_h", "_b", "_start")
