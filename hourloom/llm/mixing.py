"""Mixing sources to target weights: whole repeats, then an exact subset sum for what remains.

Each source gets a target number of words. As many whole passes over the source as fit are taken; the
remaining budget is filled with a subset of its documents. Documents are counted by exact length.
First every length gives the same share, rounded down; whole documents in a seeded order of lengths
narrow the rest; then a bounded knapsack over the lengths left, by dynamic programming on reachable
sums, hits the budget exactly or as closely as any choice can. Finally the counted number of
documents of each length is selected in a seeded order.

Only the length counts of a source meet in one task; they are bounded by its longest document. A hot
source or length is pre-aggregated and ranked bucket by bucket.

Defined results. Null texts have size 0 and are never taken. A null source is one more source after
all others. Repeated rows count as often as they occur. Extra columns are ignored by plan and kept
by mix. Sources without words have target 0. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm.order import numbered
from hourloom.llm.store import saved

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
KNAPSACK_LIMIT = 1 << 16
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def closest_subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum comes closest to the budget, the smaller sum on a tie.

    Reachable sums are the bits of an integer; each round adds a power-of-two batch of one length.
    The sums known before each batch are kept, so that the choice can be read back.
    """
    most = budget + int(lengths.max(initial=0))  # sums just above the budget may be the closest
    window = (1 << (most + 1)) - 1
    reach, steps = 1, []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        if length <= 0 or reach >> budget & 1:
            continue
        left, batch = min(count, most // length), 1
        while left > 0:
            batch = min(batch, left)
            steps.append((i, batch, reach))
            reach |= (reach << batch * length) & window
            left, batch = left - batch, batch * 2
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    total = below
    if above and below < budget:
        higher = budget + 1 + (above & -above).bit_length() - 1
        total = higher if higher - budget < budget - below else below
    taken = np.zeros(len(lengths), np.int64)
    for i, batch, before in reversed(steps):
        if not before >> total & 1:
            taken[i] += batch
            total -= batch * int(lengths[i])
    return taken


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length fill the budget."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * taken).sum())
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        room = (left - KNAPSACK_LIMIT) // max(int(lengths[i]), 1)
        more = max(0, min(int(counts[i] - taken[i]), room))
        taken[i] += more
        left -= more * int(lengths[i])
    order = np.argsort(lengths, kind="stable")
    taken[order] += closest_subset(lengths[order], (counts - taken)[order], left)
    return taken


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, no_source, source_size, target) from (source, source_size).

    A source is at its limit if the common level times its weight exceeds it. Fixing such sources
    raises the level for the others, until no more reach theirs; each step is one aggregate row.
    """
    n = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(n)) + 1)
    table = saved(
        sizes.withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * F.lit(most))
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) <= F.col("most")
        fixed, weighed = table.agg(F.sum(F.when(~free, F.col("most"))), F.sum(F.when(free, F.col("weight")))).first()
        above = (share * total - (fixed or 0.0)) / weighed if weighed else level or 0.0
        if level is not None and above <= level:
            break
        level = above
    return table.select(
        "source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level or 0.0)).alias("target")
    )


def plan(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """One row per document row: doc_id, text_hash, size, source_size, target, times (how often it is taken)."""
    text = F.col("text").cast("string")
    rows = saved(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"),
            F.xxhash64(text).alias("text_hash"),
        )
    )
    lengths = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = saved(
        source_targets(sizes, **options)
        .withColumn("_key", F.coalesce("source", F.lit("")))
        .withColumn("_none", F.col("source").isNull())
        .drop("source")
        .withColumn("repeats", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
        .withColumn("budget", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("bigint"))
    )
    key = ["_key", "_none"]
    keyed = {"_key": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()}
    counted = lengths.withColumns(keyed).drop("source").join(targets.select(*key, "budget"), key)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ignore_index=True)
        taken = fit_lengths(part["size"].to_numpy(), part["n"].to_numpy(), int(part["budget"][0]), seed)
        return part[[*key, "size"]].assign(chosen=taken)

    chosen = counted.groupBy(*key).applyInPandas(choose, "_key string, _none boolean, size bigint, chosen bigint")
    ranked = numbered(rows.withColumns(keyed).drop("source"), [*key, "size"], ["doc_id", "text_hash"], "_rank", seed)
    placed = ranked.join(saved(chosen), [*key, "size"]).join(targets.drop("budget"), key)
    extra = F.when(F.col("_rank") < F.col("chosen"), 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.col("repeats") + extra).otherwise(0)
    return placed.select("doc_id", "text_hash", "size", "source_size", "target", times.cast("bigint").alias("times"))


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mixed rows: every row of docs as often as it is taken, all columns kept."""
    chosen = plan(docs, seed, **options).where(F.col("times") > 0)
    # equal rows share a key and are counted, so that each copy keeps its own number of times
    times = chosen.groupBy(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
        F.col("text_hash").alias("_hash"),
    ).agg(F.sum("times").alias("_times"))
    key = ["_id", "_none", "_hash"]
    # the row travels as one value, so its own names cannot meet those of the helpers
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_none"),
        F.xxhash64(F.col("text").cast("string")).alias("_hash"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_order"),
    )
    same = W.partitionBy(*key)
    spread = marked.join(times, key).withColumns(
        {"_n": F.count(F.lit(1)).over(same), "_i": F.row_number().over(same.orderBy("_order")) - 1}
    )
    share = F.floor(F.col("_times") / F.col("_n")) + F.when(F.col("_i") < F.pmod("_times", "_n"), 1).otherwise(0)
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_share").cast("bigint")))
    return spread.withColumn("_share", share).where(F.col("_share") > 0).select("_row", again).select("_row.*")


def op9_digest(planned: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    taken = F.col("size") * F.col("times")
    return planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
