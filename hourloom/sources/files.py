"""Readers and writers. Parquet is the interchange format; CSV and JSON come with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """CSV scan with a header and a declared schema; a missing path fails at once."""
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _refuse_empty(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("refusing to write an empty table")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV sink for result tables. An empty table is refused before anything is overwritten."""
    _refuse_empty(df)
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    ts: str | None = None,
) -> str:
    """Parquet sink. With ts, rows are laid out by year and month so time ranges prune folders.

    Rows are rebalanced by folder: adaptive execution merges small folders and splits a hot month
    over several writers.
    """
    _refuse_empty(df)
    folders = list(partition_by)
    if ts is not None:
        df = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
        folders += ["year", "month"]
    if folders:
        df = df.hint("rebalance", *[F.col(c) for c in folders])
    writer = df.write.mode(mode)
    (writer.partitionBy(*folders) if folders else writer).parquet(path)
    return path


def dataset_manifest(
    df: DataFrame, columns: Sequence[str], ts: str = "ts", extra: dict[str, str] | None = None
) -> DataFrame:
    """One row about a table: size, time range, missing counts, column names and fixed notes."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("retrieved_rows"),
        F.min(ts).alias("datetime_min"),
        F.max(ts).alias("datetime_max"),
        *[(n - F.count(c)).alias(f"missing_{c}") for c in columns],
        F.lit(",".join(df.columns)).alias("columns"),
        *[F.lit(v).alias(k) for k, v in (extra or {}).items()],
    )


def write_manifest(manifest: DataFrame, path: str) -> str:
    manifest.write.mode("overwrite").json(path)
    return path
