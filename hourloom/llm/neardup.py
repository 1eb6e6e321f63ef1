"""Near copies by SetSketch registers: bands of registers, joint likelihood, then full shingle sets.

A document's set holds its distinct 5-word shingles (64-bit hashes). Documents with equal sets form
one class and go on as one row. Every class has REGISTERS registers
    K = clip(floor(1 - log_BASE(x)), 0, 255),
x being the smallest of the exponential values that the elements of the set have for that register.
Larger K means smaller minimum, so registers of a union are the greater ones of both: they merge.

Candidates share a band of BAND_SIZE equal registers. At similarity 0.85 a register is equal with a
chance of at least 0.85, so all BANDS bands miss a pair with a chance of
(1 - 0.85**7)**41 = 1.3e-7. Candidates go on unless the likelihood of their registers, given both set
sizes, rules out the threshold by a factor of e**RULED_OUT. The rest is confirmed on full sets: no
link is estimated.

Hot buckets are never expanded into all pairs. Round one compares each member of a bucket with a few
heads of about its own set size: those members that share most registers with everybody, HEADS per
size class. Round two takes only buckets in which more than one component is left, and pairs sets of
different components there that share a rare enough shingle to reach the threshold at all. Any
linked pair either lies within a component after round one or is compared in round two, so
components are those of the complete link graph.

Defined results. Null and wordless texts have an empty set, are linked with nothing and make a
component of their own. Fewer than 5 words are one shingle. Rows without doc_id take the smallest
doc_id of their component, or null. Repeated rows are one class and each gets its own result row.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm.components import components
from hourloom.llm.store import saved
from hourloom.llm.words import LOWER, hash_words, shingles, split_words, text_slices

WIDTH = 5
BANDS = 41
BAND_SIZE = 7
REGISTERS = BANDS * BAND_SIZE
REGISTER_BASE = 1.1
RATE = 20.0
PERCENT = 85
RULED_OUT = 16.0
HEADS = 2  # per bucket and size class; heads differ from band to band
RUN = 1 << 15  # shingles handled at once: the working arrays stay in the cache
_RANDOM = np.random.default_rng(20240229)
_FACTORS = (_RANDOM.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)

SKETCH = "struct<n: bigint, fingerprint: binary, registers: binary>"
FULL_SET = "struct<fingerprint: binary, shingles: array<bigint>>"


def registers_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (one row per set) of non-empty hash sets laid end to end; repeats change nothing."""
    one, two = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    lowest = np.empty((len(starts), REGISTERS), np.uint32)
    value = np.empty(len(hashes), np.uint32)
    for i, factor in enumerate(_FACTORS):
        np.multiply(one, factor, out=value)
        np.add(value, two, out=value)
        lowest[:, i] = np.minimum.reduceat(value, starts)
    smallest = -np.log1p(-(lowest.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1.0 - np.log(smallest) / np.log(REGISTER_BASE)), 0, 255).astype(np.uint8)


def _sets(texts: pa.Array):
    """For each slice: shingle hashes, offsets."""
    for raw, offsets in text_slices(texts):
        lowered = LOWER[raw]
        words = split_words(lowered, offsets)
        yield shingles(hash_words(lowered, words), words.offsets, WIDTH)


def _sketch(texts: pa.Array) -> pa.Array:
    n, prints, rows = [], [], []
    for hashes, offsets in _sets(texts):
        n_sets = len(offsets) - 1
        first = 0
        while first < n_sets:  # runs of sets of about RUN shingles
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN, "right")) - 1)
            held = np.flatnonzero(np.diff(offsets[first : last + 1])) + first
            drawn = {}
            if len(held):
                part = hashes[offsets[first] : offsets[last]]
                found = registers_of(part, offsets[held] - offsets[first])
                drawn = dict(zip(held.tolist(), found))
            for k in range(first, last):
                if k not in drawn:
                    n.append(0), prints.append(None), rows.append(None)
                    continue
                distinct = np.unique(hashes[offsets[k] : offsets[k + 1]])
                n.append(len(distinct))
                prints.append(hashlib.blake2b(distinct.tobytes(), digest_size=16).digest())
                rows.append(drawn[k].tobytes())
            first = last
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(rows, pa.binary())],
        names=["n", "fingerprint", "registers"],
    )


def _full_set(texts: pa.Array) -> pa.Array:
    prints, sets, ends = [], [], [0]
    for hashes, offsets in _sets(texts):
        for k in range(len(offsets) - 1):
            distinct = np.unique(hashes[offsets[k] : offsets[k + 1]])
            prints.append(hashlib.blake2b(distinct.tobytes(), digest_size=16).digest())
            sets.append(distinct.view(np.int64))
            ends.append(ends[-1] + len(distinct))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    return pa.StructArray.from_arrays([pa.array(prints, pa.binary()), lists], names=["fingerprint", "shingles"])


def _log_likelihood(j, more, fewer, same, u, v):
    """Joint log likelihood of similarity j; u and v are the shares of the two set sizes."""

    def chance(x):
        x = np.clip(x, 0.0, 1.0)
        return -np.log1p(-x * (REGISTER_BASE - 1.0) / REGISTER_BASE) / np.log(REGISTER_BASE)

    above, below = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    return (
        more * np.log(np.maximum(above, tiny))
        + fewer * np.log(np.maximum(below, tiny))
        + same * np.log(np.maximum(1.0 - above - below, tiny))
    )


def _possible(reg_a: pa.Array, reg_b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    """False where the registers rule out the threshold similarity."""
    n = len(reg_a)
    if not n:
        return pa.array([], pa.bool_())
    one = np.frombuffer(b"".join(reg_a.to_pylist()), np.uint8).reshape(n, REGISTERS)
    two = np.frombuffer(b"".join(reg_b.to_pylist()), np.uint8).reshape(n, REGISTERS)
    more, fewer = (one > two).sum(1), (one < two).sum(1)
    same = REGISTERS - more - fewer
    sizes = np.asarray(n_a, np.float64), np.asarray(n_b, np.float64)
    u, v = sizes[0] / (sizes[0] + sizes[1]), sizes[1] / (sizes[0] + sizes[1])
    threshold = PERCENT / 100
    counts = (more, fewer, same, u, v)
    at_threshold = _log_likelihood(threshold, *counts)
    grid = np.linspace(threshold, 1.0, 16)  # a better fit above the threshold never rules out
    inside = np.maximum.reduce([_log_likelihood(j, *counts) for j in grid])
    below = np.maximum.reduce([_log_likelihood(j, *counts) for j in np.linspace(0.0, threshold, 40)])
    return pa.array(below - np.maximum(inside, at_threshold) < RULED_OUT)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, fingerprint, registers) of every row; fingerprint is null for empty sets."""
    text = F.col("text").cast("string")
    read = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.arrow_udf(_sketch, SKETCH)(text).alias("s"))
    return read.select("doc_id", "text_hash", "s.*")


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, fingerprint, n, size): classes that share a band with another class; size is the bucket's."""
    bands = [
        F.xxhash64(F.lit(i), F.substring("registers", 1 + i * BAND_SIZE, BAND_SIZE)) for i in range(BANDS)
    ]
    spread = classes.select("fingerprint", "n", F.explode(F.array(*bands)).alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return spread.join(shared, "bucket")


def _size_fits(x: Column | str, y: Column | str) -> Column:
    """Sets of these sizes can reach the threshold."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _ends(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Join columns of table for both ends of each pair, as <name>_a and <name>_b."""
    for end in ("a", "b"):
        side = table.select(
            F.col("fingerprint").alias(end), *[F.col(c).alias(f"{name}_{end}") for c, name in columns.items()]
        )
        pairs = pairs.join(side, end)
    return pairs


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): those pairs whose full sets reach the threshold."""
    known = _ends(pairs, classes, {"n": "n", "registers": "reg"})
    possible = F.arrow_udf(_possible, "boolean")
    likely = saved(known.where(possible("reg_a", "reg_b", "n_a", "n_b")).select("a", "b"))
    full = _ends(likely, sets, {"shingles": "set"})
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return full.where(100 * common.cast("bigint") >= PERCENT * union.cast("bigint")).select("a", "b")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _rare_sharing(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that can still reach the threshold.

    Shingles are ordered by how few nodes hold them. If the first common shingle of two sets stands at
    places i and j, they share 1 + min(n_a - i, n_b - j) shingles at most. Only shingles at which this
    bound suffices make a pair: exact, and copies with many differences of their own drop out although
    they share buckets.
    """
    held = nodes.select("fingerprint", "n", "root", F.explode("shingles").alias("shingle"))
    held = held.join(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes")), "shingle")
    place = F.row_number().over(W.partitionBy("fingerprint").orderBy("nodes", "shingle"))
    early = held.withColumn("place", place).where(
        (100 * (F.col("n") - F.col("place") + 1) >= PERCENT * F.col("n")) & (F.col("nodes") > 1)
    )
    early = saved(early.drop("nodes"))
    x, y = early.alias("x"), early.alias("y")
    most = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") < F.col("y.root"))
    apart &= (100 + PERCENT) * most >= PERCENT * (F.col("x.n") + F.col("y.n"))
    return x.join(y, apart).select(*_ordered(F.col("x.fingerprint"), F.col("y.fingerprint"))).distinct()


def class_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): confirmed links that connect the classes of each component."""
    members = saved(_members(classes))
    weight = members.groupBy("fingerprint").agg(F.sum("size").alias("weight"))
    size_class = F.floor(F.log("n") / float(np.log(100 / PERCENT)))  # linked sets differ by one class at most
    slot = F.pmod(F.xxhash64("fingerprint"), F.lit(HEADS))
    heads = (
        members.join(weight, "fingerprint")
        .groupBy("bucket", size_class.alias("_class"), slot.alias("_slot"))
        .agg(F.max(F.struct("weight", "fingerprint", "n")).alias("top"))
        .select("bucket", F.col("top.fingerprint").alias("head"), F.col("top.n").alias("head_n"))
    )
    stars = (
        members.join(heads, "bucket")
        .where((F.col("fingerprint") != F.col("head")) & _size_fits("n", "head_n"))
        .select(*_ordered(F.col("fingerprint"), F.col("head")))
        .distinct()
    )
    stars = saved(stars)

    # one text per class that shares a bucket: its full set
    needed = weight.join(classes, "fingerprint").select(
        F.col("fingerprint").alias("class"), F.col("pick.doc_id").alias("_id"), F.col("pick.text_hash").alias("_hash")
    )
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    picked = rows.join(needed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # not deterministic: else the filter on its result would run it in the join, for every text
    set_of = F.arrow_udf(_full_set, FULL_SET).asNondeterministic()
    sets = picked.select("class", set_of("text").alias("s")).select("class", "s.*")
    # repeated rows give a set twice; a clash of text hashes gives one of another class
    sets = saved(sets.where(F.col("class") == F.col("fingerprint")).drop("class").dropDuplicates(["fingerprint"]))

    first = saved(_confirmed(stars, classes, sets))
    roots = components(first).withColumnsRenamed({"node": "fingerprint"})
    held = members.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    split = (
        held.groupBy("bucket")
        .agg(F.min("root").alias("_least"), F.max("root").alias("_most"))
        .where(F.col("_least") != F.col("_most"))
        .select("bucket")
    )
    left = saved(held.join(split, "bucket").select("bucket", "fingerprint", "n", "root"))
    cross = _rare_sharing(left.select("fingerprint", "n", "root").distinct().join(sets, "fingerprint"))
    second = _confirmed(saved(cross.join(stars, ["a", "b"], "left_anti")), classes, sets)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_shingles, fingerprint, root, component_id, kept.

    root is the same for all rows of a component, and null for empty sets.
    """
    rows = saved(sketches(docs))
    pick = F.min(F.struct("doc_id", "text_hash")).alias("pick")
    full = rows.where(F.col("n") > 0)
    classes = saved(
        full.groupBy("fingerprint").agg(
            pick, F.min("doc_id").alias("lowest"), F.first("n").alias("n"), F.first("registers").alias("registers")
        )
    )
    links = class_links(docs, classes)
    roots = components(links).withColumnsRenamed({"node": "fingerprint"})
    labelled = classes.select("fingerprint", "lowest").join(roots, "fingerprint", "left")
    labelled = saved(labelled.withColumn("root", F.coalesce("root", "fingerprint")))
    names = labelled.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = labelled.join(names, "root").select("fingerprint", "root", "component_id")
    out = rows.drop("registers").join(named, "fingerprint", "left")
    own = F.when(F.col("fingerprint").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "fingerprint", "root", own.alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, and of equal ones the first by text hash.

    Components are told apart by their root, since those of rows without doc_id share a null component_id
    and unrelated texts can share a doc_id. Rows of empty sets stay. All columns are kept.
    """
    found = near_duplicates(docs)
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "times")).alias("pick")
    one = rows.where(F.col("root").isNotNull()).groupBy("root").agg(first)
    one = one.select("root", "pick.doc_id", "pick.text_hash", "pick.times")
    chosen = saved(
        one.unionByName(rows.where(F.col("root").isNull())).select(
            "root",
            "times",
            F.coalesce("doc_id", F.lit(0)).alias("_key"),
            F.col("doc_id").isNull().alias("_none"),
            F.col("text_hash").alias("_hash"),
        )
    )
    names = docs.columns
    marked = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"),
        F.coalesce("doc_id", F.lit(0)).alias("_key"),
        F.col("doc_id").isNull().alias("_none"),
        F.xxhash64(F.col("text").cast("string")).alias("_hash"),
    )
    key = ["_key", "_none", "_hash"]
    single = F.col("root").isNull() | (F.col("times") == 1)
    alone = marked.join(chosen.where(single).select(*key), key).select("_row.*")
    # repeats of a picked row: each task of the join reduces its own to one before they meet
    ordered = F.struct(*[F.col(f"_row.`{n}`") for n in names if n != "text"], F.col("_row.text"))
    again = marked.join(chosen.where(~single).select(*key, "root"), key).select("root", "_row")
    again = again.groupBy("root").agg(F.min(ordered).alias("_row"))
    return alone.unionByName(again.select(*[F.col(f"_row.`{n}`") for n in names]))


def op3_digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select("doc_id", "n_shingles", "component_id", "kept")
