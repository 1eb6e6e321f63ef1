"""Sums of products of many columns in one pass.

A task folds its rows into one fixed-size table per block (means and products of deviations, merged by the
pairwise update, so large offsets cost no digits) and hands over one binary row for it. These rows are
added up in SUM_TASKS tasks before the driver adds the rest; what reaches it is bounded by blocks times
columns squared. Nothing is shuffled but these tables.

Where many keys have few columns, series_moments() keeps to built-in aggregates instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM_TASKS = 16
TABLE = "block int, slot int, cells binary"


@dataclass(frozen=True)
class Moments:
    """Row count, means, and sums of products of deviations from the means."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0.0, np.zeros(width), np.zeros((width, width)))

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        if not len(rows):
            return cls.none(rows.shape[1])
        mean = rows.mean(axis=0)
        centred = rows - mean
        return cls(float(len(rows)), mean, centred.T @ centred)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        step = other.mean - self.mean
        spread = np.outer(step, step) * (self.n * other.n / n)
        return Moments(n, self.mean + step * (other.n / n), self.products + other.products + spread)

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.products.ravel()]).tobytes()

    @classmethod
    def unpack(cls, cells: bytes, width: int) -> Moments:
        flat = np.frombuffer(cells, np.float64)
        return cls(flat[0], flat[1 : width + 1], flat[width + 1 :].reshape(width, width))


def total(parts: Iterable[Moments], width: int) -> Moments:
    return reduce(Moments.__add__, parts, Moments.none(width))


def _table(found: dict[int, bytes], slot: int) -> pa.RecordBatch:
    columns = [
        pa.array(list(found), pa.int32()),
        pa.array([slot] * len(found), pa.int32()),
        pa.array(list(found.values()), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "slot", "cells"])


def _summed(rows: DataFrame, fold, add, unpack) -> dict:
    """Tables by block: folded in each task, added up by slot, then on the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _table(fold(batches), TaskContext.get().partitionId() % SUM_TASKS)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, slot = {}, 0
        for batch in batches:
            slot = batch.column("slot")[0].as_py() if batch.num_rows else slot
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                found[block] = add(found[block], unpack(cells)) if block in found else unpack(cells)
        yield _table({b: m.pack() if hasattr(m, "pack") else m.tobytes() for b, m in found.items()}, slot)

    tables = rows.mapInArrow(first, TABLE).repartition(SUM_TASKS, "slot").mapInArrow(second, TABLE)
    result: dict = {}
    for r in sorted(tables.collect(), key=lambda r: (r["block"], r["slot"])):  # SUM_TASKS rows a block at most
        cells = unpack(bytes(r["cells"]))
        result[r["block"]] = add(result[r["block"]], cells) if r["block"] in result else cells
    return result


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Rows of doubles, missing values as nan."""
    cells = [batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(columns)]
    return np.column_stack(cells).astype(np.float64, copy=False) if batch.num_rows else np.zeros((0, columns))


def _doubles(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]


def block_moments(df: DataFrame, columns: Sequence[str], block: Column | None = None) -> dict[int, Moments]:
    """Moments of the columns by block, over rows without a missing value; for few blocks."""
    width = len(columns)
    rows = df.select((F.lit(0) if block is None else block).cast("int").alias("block"), *_doubles(columns))

    def fold(batches: Iterator[pa.RecordBatch]) -> dict[int, bytes]:
        found: dict[int, Moments] = {}
        for batch in batches:
            cells, blocks = _matrix(batch, width), batch.column("block").to_numpy(zero_copy_only=False)
            complete = ~np.isnan(cells).any(axis=1)
            for b in np.unique(blocks[complete]):
                more = Moments.of(cells[complete & (blocks == b)])
                found[int(b)] = found[int(b)] + more if int(b) in found else more
        return {b: m.pack() for b, m in found.items()}

    return _summed(rows, fold, Moments.__add__, lambda cells: Moments.unpack(cells, width))


@dataclass(frozen=True)
class PairSums:
    """For each pair of columns, over the rows that hold both: counts, sums, squares and products.

    sums[i, j] and squares[i, j] are those of column i where j is present. Values are taken from a common
    origin per column, so the sums stay small.
    """

    counts: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    def correlation(self) -> np.ndarray:
        """Pairwise complete Pearson correlations; nan where a column does not vary or fewer than two rows hold both."""
        with np.errstate(all="ignore"):
            mean = self.sums / self.counts
            spread = self.squares / self.counts - mean**2
            spread = np.where(spread > 1e-13 * (self.squares / self.counts), spread, 0.0)
            covariance = self.products / self.counts - mean * mean.T
            found = covariance / np.sqrt(spread * spread.T)
        return np.where((self.counts > 1) & (spread > 0) & (spread.T > 0), np.clip(found, -1.0, 1.0), np.nan)


def pair_sums(df: DataFrame, columns: Sequence[str]) -> PairSums:
    """One pass over any number of columns, after one that finds the origins."""
    width = len(columns)
    means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    origin = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    shape = (4, width, width)

    def fold(batches: Iterator[pa.RecordBatch]) -> dict[int, bytes]:
        sums = np.zeros(shape)
        for batch in batches:
            cells = _matrix(batch, width) - origin
            held = ~np.isnan(cells)
            there, values = held.astype(np.float64), np.where(held, cells, 0.0)
            sums += [there.T @ there, values.T @ there, (values * values).T @ there, values.T @ values]
        return {0: sums.tobytes()}

    tables = _summed(df.select(*_doubles(columns)), fold, np.add, lambda c: np.frombuffer(c, np.float64).reshape(shape))
    return PairSums(*(tables[0] if tables else np.zeros(shape)))


def series_moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, n, means, products): one row per key with the moments of its complete rows, as arrays.

    Built-in aggregates with map-side combine, so a key with many rows shrinks before it travels. Products
    are the sums of products of deviations for i <= j, row by row.
    """
    complete = df.na.drop(subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    n = F.count(F.lit(1)).cast("double")
    return complete.groupBy(*keys).agg(
        n.alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("means"),
        F.array(*[F.covar_pop(a, b) * n for a, b in pairs]).alias("products"),
    )
