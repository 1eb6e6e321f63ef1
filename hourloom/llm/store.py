"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def local_folder() -> str:
    """One folder for this process, for local sessions without a setting."""
    return "file://" + tempfile.mkdtemp(prefix="hourloom-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir.

    The setting is read from the session. Where it is unset a local session (tests, laptops) gets a
    temporary folder; any other master is refused, because executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = local_folder()
    return f"{base.rstrip('/')}/hourloom/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, short lineage.

    A lost executor costs its running tasks only. The files stay until the folder is cleared, since
    the returned frame is lazy.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
