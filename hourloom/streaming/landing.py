"""Incremental landing: every new payload chunk is flattened once and appended to a Parquet table.

The file source tracks which chunks it has read, and the Parquet sink commits per batch, so a
restarted job neither loses nor repeats a chunk. Checkpoints belong on shared storage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hourloom.sources.payloads import (
    MEASUREMENT_PAYLOAD,
    flatten_hourly,
    flatten_measurements,
    hourly_payload_schema,
)


def stream_measurements(spark: SparkSession, folder: str) -> DataFrame:
    payload = spark.readStream.schema(MEASUREMENT_PAYLOAD).option("multiLine", True).json(folder)
    return flatten_measurements(payload)


def stream_hourly(
    spark: SparkSession, folder: str, variables: Mapping[str, str] | Sequence[str], input_zone: str = "UTC"
) -> DataFrame:
    payload = (
        spark.readStream.schema(hourly_payload_schema(list(variables))).option("multiLine", True).json(folder)
    )
    return flatten_hourly(payload, variables, input_zone)


def append_new_chunks(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Process the chunks that arrived since the last call, then stop; call awaitTermination()."""
    return (
        rows.withColumns({"year": F.year("ts"), "month": F.month("ts")})
        .writeStream.format("parquet")
        .partitionBy("year", "month")
        .option("checkpointLocation", checkpoint)
        .option("path", table)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
