"""Independent Spark jobs submitted together, and the stored tables they share.

Training a small model is a long row of small Spark jobs, each far from filling the cluster. Fits that do
not depend on each other are therefore submitted from a bounded pool of threads, each in a scheduler pool
of its own, so that with fair scheduling no fit waits behind another one's tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

THREADS = 8
PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class Job:
    """Some work that no other job depends on; greater cost starts first."""

    name: Hashable
    work: Callable[[], Any]
    cost: float = 1.0


def run_jobs(spark: SparkSession, jobs: Sequence[Job], threads: int = THREADS) -> dict[Hashable, Any]:
    """Results by name, in the order given. The first failure ends what has not started and is raised."""
    if len({j.name for j in jobs}) != len(jobs):
        raise ValueError("job names must differ")

    def submitted(job: Job) -> Callable[[], Any]:
        def work() -> Any:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"job-{job.name}")
            return job.work()

        return inheritable_thread_target(spark)(work)

    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(jobs) or 1))) as pool:
        order = sorted(jobs, key=lambda j: -j.cost)
        futures = {j.name: pool.submit(submitted(j)) for j in order}
        done, waiting = wait(futures.values(), return_when=FIRST_EXCEPTION)
        for future in waiting:
            future.cancel()
        for future in done:
            future.result()
    return {j.name: futures[j.name].result() for j in jobs}


def stored(df: DataFrame) -> DataFrame:
    """df computed once, with a short lineage, as a checkpoint in the shared folder.

    Without a checkpoint folder (plain local sessions) the rows are persisted instead.
    """
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def partitions_for(rows: int, columns: int) -> int:
    """As many partitions as rows of doubles need."""
    return max(1, -(-rows * (columns + 2) * 8 // PARTITION_BYTES))


def vector_table(df: DataFrame, columns: Sequence[str], keep: Sequence[str], rows: int) -> DataFrame:
    """(features, keep...) for training, persisted, in as few partitions as its bytes need."""
    wide = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df).select("features", *keep)
    parts, have = partitions_for(rows, len(columns)), wide.rdd.getNumPartitions()
    dealt = wide.coalesce(parts) if parts <= have else wide.repartition(parts)
    table = stored(dealt).persist(StorageLevel.MEMORY_AND_DISK)
    table.count()
    return table
