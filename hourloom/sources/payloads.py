"""Readers for the two nested payload shapes: measurement records and parallel hourly arrays.

Payload files land in a folder in chunks. Reading the folder unions the chunks; a folder laid out
by date is pruned by its path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.functions.numeric import to_number
from hourloom.functions.timecols import to_instant

RECORD = T.StructType(
    [
        T.StructField("date", T.StructType([T.StructField("utc", T.StringType())])),
        T.StructField("parameter", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField(
            "coordinates",
            T.StructType(
                [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
            ),
        ),
    ]
)
MEASUREMENT_PAYLOAD = T.StructType([T.StructField("results", T.ArrayType(RECORD))])

STATION_LIST_PAYLOAD = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [T.StructField("name", T.StringType()), T.StructField("parameters", T.ArrayType(T.StringType()))]
                )
            ),
        )
    ]
)


def hourly_payload_schema(variables: Sequence[str]) -> T.StructType:
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))]
    arrays += [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    return T.StructType([T.StructField("hourly", T.StructType(arrays))])


def flatten_measurements(payload: DataFrame) -> DataFrame:
    """Measurement payloads to long rows; records without a usable time are dropped."""
    records = payload.select(F.explode("results").alias("r"))
    return records.select(
        to_instant("r.date.utc").alias("ts"),
        "r.parameter",
        to_number("r.value").alias("value"),
        "r.unit",
        "r.location",
        "r.city",
        "r.country",
        "r.coordinates.latitude",
        "r.coordinates.longitude",
    ).where(F.col("ts").isNotNull())


def flatten_hourly(
    payload: DataFrame, variables: Mapping[str, str] | Sequence[str], input_zone: str = "UTC"
) -> DataFrame:
    """Parallel hourly arrays to one row per hour, renamed by a {payload name: column} mapping."""
    names = dict(variables) if isinstance(variables, Mapping) else {v: v for v in variables}
    zipped = F.arrays_zip(*[F.col(f"hourly.{c}") for c in ["time", *names]])
    rows = payload.where(F.col("hourly.time").isNotNull()).select(F.explode(zipped).alias("h"))
    return rows.select(
        to_instant("h.time", input_zone).alias("ts"),
        *[to_number(f"h.{source}").alias(name) for source, name in names.items()],
    ).where(F.col("ts").isNotNull())


def read_chunks(
    spark: SparkSession, folder: str, schema: T.StructType, start: str | None = None, end: str | None = None
) -> DataFrame:
    """All payload chunks of a landing folder, one JSON document per file.

    Chunks kept under chunk_date=YYYY-MM-DD folders are pruned by their path when a range is given.
    """
    payload = spark.read.schema(schema).option("multiLine", True).json(folder)
    if "chunk_date" in payload.columns:
        day = F.col("chunk_date").cast("date")
        if start is not None:
            payload = payload.where(day >= F.lit(start).cast("date"))
        if end is not None:
            payload = payload.where(day <= F.lit(end).cast("date"))
    return payload


def read_measurements(
    spark: SparkSession, folder: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    return flatten_measurements(read_chunks(spark, folder, MEASUREMENT_PAYLOAD, start, end))


def read_hourly(
    spark: SparkSession,
    folder: str,
    variables: Mapping[str, str] | Sequence[str],
    input_zone: str = "UTC",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    payload = read_chunks(spark, folder, hourly_payload_schema(list(variables)), start, end)
    return flatten_hourly(payload, variables, input_zone)


def json_field(text: Column | str, path: str, default: str | None = None) -> Column:
    """Nested JSON access with a default."""
    found = F.get_json_object(text, path)
    return found if default is None else F.coalesce(found, F.lit(default))


def parameter_ids(parameters: Column) -> Column:
    """Ids of a station's parameters, each given as a plain string or as an object with an id."""
    return F.transform(
        parameters,
        lambda p: F.when(p.startswith("{"), F.get_json_object(p, "$.id")).otherwise(p),
    )


def stations_with_parameter(payload: DataFrame, parameter: str) -> DataFrame:
    """Station names with a flag: does the station report the parameter?"""
    station = payload.select(F.explode("results").alias("s"))
    listed = F.array_contains(parameter_ids(F.col("s.parameters")), parameter)
    return station.select(
        F.coalesce("s.name", F.lit("Unknown")).alias("name"),
        F.coalesce(listed, F.lit(False)).alias("has_parameter"),
    )
