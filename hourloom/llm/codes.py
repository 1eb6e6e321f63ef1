"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry.

A component x becomes the integer floor(256 * x). The vector is cut into PARTS equal parts, each with a
codebook of its own that starts from the first ENTRIES vectors by vec_id and is refined in ROUNDS rounds:
assign every part to its nearest entry, replace each entry by the floored mean of its parts.

The nearest entry is found by equal-average search. Entries are sorted by component sum; a search expands
outward from the part's own sum, lower and higher sums by turns, and a side ends once its squared sum gap
over the dimension strictly exceeds the best squared distance so far: by Cauchy's inequality no farther
entry can be as near. Ties go to the lower index, which is why equality goes on. Everything is integer
arithmetic, so the result does not depend on how rows are dealt.

Scale. A round is one pass over the vectors; a task folds its rows into one fixed-size table of counts
and sums, one row a task, and these are added up in SUM_TASKS tasks before the driver sees them. Codebooks
(ENTRIES x dimension integers) travel in the task closure. Labels with more than a thousandth of the rows
are at most a thousand and broadcast; all others are joined, so no label gathers in one task.

Defined results. Dropped: null vectors, vectors with a null or non-finite component, empty vectors, and
those of another length than the first kept vector by (vec_id, components). A length that is no multiple
of PARTS is filled up with zeros. Null vec_ids come last, equal ones in the order of their components;
repeated rows each count and give their own row. Integers are clamped to +-limit, about 1.9e8 at dimension
64, so that every squared distance fits a long; label_error is clamped to a long too. With fewer than
ENTRIES rows the codebooks are smaller; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.store import saved

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
SUM_TASKS = 32  # tasks that add up the tables of a round, and rows that reach the driver
HOT = 1000  # a label with more than one row in HOT is broadcast: fewer than HOT labels
BATCH = 1 << 14  # vectors searched at once in a task
LONG_MAX = (1 << 63) - 1


def limit(dimension: int, parts: int) -> int:
    """Greatest integer component for which squared distances and squared sum gaps fit a long."""
    width = padded(dimension, parts) // parts
    return math.isqrt(LONG_MAX // max(dimension, width * width)) // 2 - 1


def padded(dimension: int, parts: int) -> int:
    return -(-dimension // parts) * parts


def integers(vectors: pa.Array, dimension: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept row numbers, integer components) of a list column."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    lengths = np.diff(np.asarray(lists.offsets))
    right = (lengths == dimension) & ~np.asarray(lists.is_null())
    flat = lists.values.to_numpy(zero_copy_only=False)  # null components become nan
    starts = np.asarray(lists.offsets)[:-1][right]
    cells = flat[(starts[:, None] + np.arange(dimension)).ravel()].reshape(-1, dimension)
    finite = np.isfinite(cells).all(axis=1)
    most = limit(dimension, parts)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(cells[finite] * float(SCALE)), -most, most).astype(np.int64)
    fill = padded(dimension, parts) - dimension
    return np.flatnonzero(right)[finite], np.pad(whole, ((0, 0), (0, fill)))


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, by equal-average search."""
    n, dimension = rows.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, sorted_entries = sums[order], entries[order]
    own = rows.sum(axis=1)
    best, index = np.full(n, LONG_MAX), np.full(n, len(order))
    start = np.searchsorted(sums, own)
    # one cursor to lower sums and one to higher sums; a row leaves a side once that side is over
    sides = [(np.arange(n), start - 1, -1), (np.arange(n), start, 1)]
    while any(len(live) for live, _, _ in sides):
        following = []
        for live, at, step in sides:
            ok = (at >= 0) & (at < len(order))
            live, at = live[ok], at[ok]
            gap = own[live] - sums[at]
            ok = _within(gap, best[live], dimension)
            live, at = live[ok], at[ok]
            if len(live):
                difference = rows[live] - sorted_entries[at]
                distance = np.einsum("ij,ij->i", difference, difference)
                number = order[at]
                better = (distance < best[live]) | ((distance == best[live]) & (number < index[live]))
                best[live[better]], index[live[better]] = distance[better], number[better]
            following.append((live, at + step, step))
        sides = following
    return index, best


def _within(gap: np.ndarray, best: np.ndarray, dimension: int) -> np.ndarray:
    """gap**2 / dimension <= best, in integers: the ceiling of gap**2 over the dimension is compared."""
    return -((-gap * gap) // dimension) <= best


def assign(rows: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes per part, error per vector)."""
    width = rows.shape[1] // len(books)
    codes, error = np.zeros((len(rows), len(books)), np.int64), np.zeros(len(rows), np.int64)
    for p, book in enumerate(books):
        codes[:, p], distance = nearest(rows[:, p * width : (p + 1) * width], book)
        error += distance
    return codes, error


def _batches(batches: Iterator[pa.RecordBatch], dimension: int, parts: int):
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH):
            piece = batch.slice(first, BATCH)
            kept, rows = integers(piece.column("embedding"), dimension, parts)
            if len(kept):
                yield piece, kept, rows


def _round(vectors: DataFrame, books: list[np.ndarray], dimension: int) -> list[np.ndarray]:
    """The codebooks after one assignment of all vectors."""
    parts, size = len(books), len(books[0])
    width = books[0].shape[1]
    shape = (parts, size, width + 1)

    def table(cells: np.ndarray, slot: int) -> pa.RecordBatch:
        columns = [pa.array([slot], pa.int32()), pa.array([cells.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["slot", "cells"])

    def fold(batches):
        from pyspark import TaskContext

        cells = np.zeros(shape, np.int64)  # per entry the sums of its parts, and their number
        for _, _, rows in _batches(batches, dimension, parts):
            codes, _ = assign(rows, books)
            for p in range(parts):
                part = rows[:, p * width : (p + 1) * width]
                np.add.at(cells[p, :, :width], codes[:, p], part)
                cells[p, :, width] += np.bincount(codes[:, p], minlength=size)
        yield table(cells, TaskContext.get().partitionId() % SUM_TASKS)

    def add(batches):
        cells, slot = np.zeros(shape, np.int64), None
        for batch in batches:
            for slot, one in zip(batch.column("slot").to_pylist(), batch.column("cells").to_pylist()):
                cells += np.frombuffer(one, np.int64).reshape(shape)
        if slot is not None:
            yield table(cells, slot)

    tables = vectors.mapInArrow(fold, "slot int, cells binary")
    added = tables.repartition(SUM_TASKS, "slot").mapInArrow(add, "slot int, cells binary")
    total = sum(np.frombuffer(r["cells"], np.int64).reshape(shape) for r in added.collect())  # SUM_TASKS rows at most
    counts = total[:, :, width:]
    means = np.where(counts > 0, total[:, :, :width] // np.maximum(counts, 1), np.stack(books))
    return list(means)


def _finite(vector: Column) -> Column:
    def good(x):
        return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)

    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(codebooks by part, dimension) over all kept vectors; no codebooks for an empty table."""
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(_finite(F.col("embedding")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
    start = [r["embedding"] for r in first.collect()]
    if not start:
        return [], 0
    dimension = len(start[0])
    if any(len(v) != dimension for v in start):
        alike = kept.where(F.size("embedding") == dimension)
        start = [r["embedding"] for r in alike.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    cells = pa.array(start, pa.list_(pa.float64()))
    _, rows = integers(cells, dimension, parts)
    books = [np.ascontiguousarray(b) for b in np.split(rows, parts, axis=1)]
    for _ in range(rounds):
        books = _round(vectors.select("embedding"), books, dimension)
    return books, dimension


def encode(vectors: DataFrame, books: list[np.ndarray], dimension: int) -> DataFrame:
    """(vec_id, label, codes binary with one byte a part, error) of the kept rows."""
    kinds = vectors.select("vec_id", "label").schema

    def codes_of(batches):
        for piece, kept, rows in _batches(batches, dimension, len(books)):
            codes, error = assign(rows, books)
            cells = codes.astype(np.uint8)
            columns = [
                piece.column("vec_id").take(pa.array(kept)),
                piece.column("label").take(pa.array(kept)),
                pa.array([c.tobytes() for c in cells], pa.binary()),
                pa.array(error),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "codes", "error"])

    schema = kinds.add("codes", T.BinaryType()).add("error", T.LongType())
    return vectors.select("vec_id", "label", "embedding").mapInArrow(codes_of, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error: the sum of error over equal labels, nulls together."""
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.least(exact, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("bigint")
    sums = saved(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"), F.count(F.lit(1)).alias("_n")))
    rows = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    frequent = sums.where(F.col("_n") * HOT > rows).drop("_n")
    rare = sums.where(F.col("_n") * HOT <= rows).drop("_n")
    same = F.col("label").eqNullSafe(F.col("_label"))
    told = coded.join(F.broadcast(frequent), same, "left")
    found = told.where(F.col("label_error").isNotNull()).drop("_label")
    left = told.where(F.col("label_error").isNull()).drop("_label", "label_error")
    return found.unionByName(left.join(rare, same).drop("_label"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(coded rows with label_error, codebooks) of a table with vec_id, embedding and label."""
    if not 1 <= entries <= 256:
        raise ValueError("an index must fit one byte")
    books, dimension = codebooks(vectors, parts, entries, rounds)
    if not books:
        empty = vectors.select("vec_id", "label").where(F.lit(False))
        nothing = {"codes": F.lit(b""), "error": F.lit(0).cast("bigint"), "label_error": F.lit(0).cast("bigint")}
        return empty.withColumns(nothing), books
    return with_label_error(saved(encode(vectors, books, dimension))), books


def decoded(codes: bytes, books: list[np.ndarray]) -> list[float]:
    """The vector that a code stands for: the middle of each integer's range."""
    whole = np.concatenate([book[c] for c, book in zip(codes, books)])
    return ((whole + 0.5) / SCALE).tolist()


def books_sha256(books: list[np.ndarray]) -> str:
    cells = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return hashlib.sha256(cells.encode()).hexdigest()


def op12_digest(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The columns of the registered query."""
    return coded.select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(books_sha256(books)).alias("codebooks_sha256"),
    )
