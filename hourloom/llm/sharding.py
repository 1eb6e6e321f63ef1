"""Shards that keep equal texts together: balanced label propagation under capacity quotas.

Built from DataFrame functions only. Rows with equal texts are linked. Every group of linked rows
starts spread over the shards by a hash of doc_id; the state of the propagation is one count per
(group, shard), never rows or links. In each round a group looks at its neighbours' shards and wants
its rows in the shard that holds most of them, unless the group nearly fills that shard. Demand is
added up per pair of shards. A mover out frees a place in, so the flows between shards may exceed the
free room as far as they cancel: full shards exchange rows, in pairs or along longer cycles. What is
still in want of a place is exchanged for small groups that lie in the wanted shard as a whole and
lose nothing by moving. Every mover of a pair of shards gets the same chance, drawn by a seeded hash,
so that single rows move too and the quota holds on average. A group never comes into more shards
than it has. Rounds end when less than a thousandth of the linked rows can move; the order at the end
holds the quotas exactly.

The law is `rows`: counts differ by one at most. Rows without a partner fill what is left. All rows
are then put in one order - by wanted shard, linked rows first, group by group - and cut at exact
quotas, which gives shard and slot at once. Ranks come from bucket counts, so neither a hot group
nor a shard is sorted in one task.

Defined results. A null text is linked with nothing and has size 1. An empty text is a text. Repeated
rows are linked like other equal texts. Extra columns are ignored by assign and kept by shard_rows.
Rows that agree in all of doc_id, text and order are alike. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm.order import numbered
from hourloom.llm.store import saved

SHARDS = 16
ROUNDS = 60  # a bound; rounds end when hardly a row can move
GROUP_BUCKETS = 256
ROW_BUCKETS = 64
SEED = 5


def _by_shard(numbers: list[int], shard: Column) -> Column:
    """The entry of a list with one number per shard."""
    return F.element_at(F.array(*[F.lit(x).cast("bigint") for x in numbers]), shard.cast("int") + 1)


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one per shard
    return [found.get(s, 0) for s in range(shards)]


def flows(wants: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """Rows that may go from shard to shard: at most those that want to, and into no shard more than room and leavers.

    Starts with all demand and lowers what enters an overfull shard until all shards fit. Works on one number per
    pair of shards. The result fits but need not be the greatest: leavers of a shard that nobody enters take up places
    of a cycle until little of it is left, and exchanges make up for that. Negative room (more rows than the quota) counts as none: such a shard still exchanges rows.
    """
    flow = {pair: float(n) for pair, n in wants.items()}
    for _ in range(1000):
        leaving, entering = [0.0] * len(room), [0.0] * len(room)
        for (a, b), n in flow.items():
            leaving[a] += n
            entering[b] += n
        fits = [max(0, r) + x for r, x in zip(room, leaving)]
        if all(e <= f + 1e-3 for e, f in zip(entering, fits)):
            break
        flow = {(a, b): n * min(1.0, fits[b] / entering[b]) if entering[b] else 0.0 for (a, b), n in flow.items()}
    return flow


def exchanges(
    wants: dict[tuple[int, int], int], flow: dict[tuple[int, int], float], whole: dict[int, int]
) -> dict[tuple[int, int], float]:
    """Rows of whole groups that go from b to a, so that as many may come from a to b beyond the flow."""
    missing = {pair: max(0.0, n - flow[pair]) for pair, n in wants.items()}
    into: dict[int, float] = {}
    for (_, b), n in missing.items():
        into[b] = into.get(b, 0.0) + n
    return {(b, a): n * min(1.0, whole.get(b, 0) / into[b]) for (a, b), n in missing.items() if into[b]}


def _where_to(out: dict[tuple[int, int], float], whole: dict[int, int], shards: int, drawn: Column) -> Column:
    """The shard that a whole group moves to, null if it stays: bounds on the draw by shard, one per pair."""
    bounds = []
    for a in range(shards):
        at, row = 0.0, []
        for b in range(shards):
            at += out.get((a, b), 0.0) / whole[a] if whole.get(a) else 0.0
            row.append(F.struct(F.lit(at).alias("upto"), F.lit(b).alias("to")))
        bounds.append(F.array(*row))
    mine = F.element_at(F.array(*bounds), F.col("shard").cast("int") + 1)
    return F.get(F.filter(mine, lambda x: drawn < x["upto"]), F.lit(0))["to"]


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move the counts n of (grp, shard) towards the fullest shards of their groups; loads stay near the quotas."""
    shards = len(quotas)
    in_group = W.partitionBy("grp")  # one row per shard at most
    for step in range(rounds):
        tie = F.xxhash64("grp", "shard", F.lit(step))
        # a shard that the group fills but for an eighth can be kept but not joined: it has hardly a place to give
        takes = 8 * F.col("n") < 7 * _by_shard(quotas, F.col("shard"))
        best = F.max(F.when(takes, F.struct("n", tie.alias("tie"), "shard"))).over(in_group)["shard"]
        wanting = cells.withColumn("best", best).withColumn("_cells", F.count(F.lit(1)).over(in_group))
        moves = takes & (F.col("best") != F.col("shard"))
        light = F.col("n") * shards <= _by_shard(quotas, F.col("shard"))
        wanting = wanting.select(
            "grp", "shard", "n", F.when(moves, F.col("best")).alias("to"), ((F.col("_cells") == 1) & light).alias("_whole")
        )
        table = wanting.groupBy("shard", "to", "_whole").agg(F.sum("n").alias("n")).collect()  # two per pair of shards
        loads, whole, wants = [0] * shards, {}, {}
        for r in table:
            loads[r["shard"]] += r["n"]
            if r["_whole"]:
                whole[r["shard"]] = r["n"]
            elif r["to"] is not None:
                wants[r["shard"], r["to"]] = wants.get((r["shard"], r["to"]), 0) + r["n"]
        flow = flows(wants, [q - x for q, x in zip(quotas, loads)])
        out = exchanges(wants, flow, whole)
        going = {(a, b): n + out.get((b, a), 0.0) for (a, b), n in flow.items()}
        if 1000 * sum(going.values()) < max(1000, sum(loads)):
            break
        chances = [going.get((a, b), 0.0) / wants.get((a, b), 1) for a in range(shards) for b in range(shards)]
        pair = (F.col("shard") * shards + F.col("to")).cast("int") + 1
        chance = F.element_at(F.array(*map(F.lit, chances)), pair)
        drawn = F.pmod(F.xxhash64(F.lit(step), "shard", "grp"), F.lit(1 << 20)) / float(1 << 20)
        to = F.when(F.col("_whole"), _where_to(out, whole, shards, drawn)).otherwise(F.col("to"))
        part = F.when(F.col("_whole"), F.col("n")).otherwise(F.least("n", F.floor(F.col("n") * chance + drawn)))
        split = wanting.withColumn("_moved", part).withColumn("to", to)
        split = split.withColumn("_moved", F.when(F.col("to").isNull(), 0).otherwise(F.col("_moved")))
        stay = split.select("grp", "shard", (F.col("n") - F.col("_moved")).alias("n"))
        come = split.where(F.col("_moved") > 0).select("grp", F.col("to").alias("shard"), F.col("_moved").alias("n"))
        cells = saved(stay.unionByName(come).where(F.col("n") > 0).groupBy("grp", "shard").agg(F.sum("n").alias("n")))
    return cells


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document row: doc_id, text_hash, size, text_crc32, shard, slot."""
    text = F.col("text").cast("string")
    group = F.when(text.isNotNull(), F.md5(text))
    rows = saved(
        docs.select(
            "doc_id",
            F.xxhash64(text).alias("text_hash"),
            group.alias("grp"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        )
    )
    start = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(shards)).cast("int").alias("shard")
    first = rows.where(F.col("grp").isNotNull()).groupBy("grp", start).agg(F.count(F.lit(1)).alias("n"))
    linked = F.sum("n").over(W.partitionBy("grp")) > 1  # one row per shard of a group
    cells = saved(first.withColumn("_linked", linked).where("_linked").drop("_linked"))
    n_rows = rows.count()
    quotas = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    cells = propagate(cells, quotas, rounds)

    # rows of a group, in seeded order, go to its shards in turn
    along = W.partitionBy("grp").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    upto = cells.withColumn("upto", F.sum("n").over(along))
    places = saved(upto.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("places")))
    joined = rows.join(places, "grp", "left")
    alone = joined.where(F.col("places").isNull()).drop("places")
    together = numbered(joined.where(F.col("places").isNotNull()), ["grp"], ["doc_id", "text_hash"], "_rank", SEED, ROW_BUCKETS)
    held = F.filter("places", lambda p: F.col("_rank") < p["upto"])
    together = together.withColumn("want", F.element_at(held, 1)["shard"]).drop("places", "_rank")

    # unlinked rows fill what the groups leave, shard after shard
    left = [max(0, q - x) for q, x in zip(quotas, _loads(cells, shards))]
    counted = alone.withColumn("_all", F.lit(0))
    filled = numbered(counted, ["_all"], ["doc_id", "text_hash"], "_rank", SEED, GROUP_BUCKETS * ROW_BUCKETS)
    bounds = [sum(left[: s + 1]) for s in range(shards)]
    want = reduce(lambda c, s: F.when(F.col("_rank") < bounds[s], s).otherwise(c), range(shards - 2, -1, -1), F.lit(shards - 1))
    filled = filled.withColumn("want", want).drop("_rank", "_all")
    order = saved(
        together.withColumn("_alone", F.lit(0)).unionByName(filled.withColumn("_alone", F.lit(1)))
        .withColumn("_g", F.pmod(F.xxhash64(F.coalesce("grp", F.lit(""))), F.lit(GROUP_BUCKETS)))
        .withColumn("_r", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text_hash"), F.lit(ROW_BUCKETS)))
    )

    # one order of all rows, cut at the quotas
    key = ["want", "_alone", "_g", "_r"]
    counts = order.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    parts = counts.groupBy("want", "_alone").agg(F.sum("_c").alias("_n"))
    before_part = W.orderBy("want", "_alone").rowsBetween(W.unboundedPreceding, -1)  # two rows per shard
    parts = parts.withColumn("_part", F.coalesce(F.sum("_n").over(before_part), F.lit(0))).drop("_n")
    along = W.partitionBy("want", "_alone").orderBy("_g", "_r").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(along), F.lit(0))).drop("_c")
    starts = starts.join(parts, ["want", "_alone"])
    inside = W.partitionBy(*key).orderBy("grp", "doc_id", "text_hash")
    ranked = order.join(starts, key).withColumn(
        "_rank", F.col("_part") + F.col("_before") + F.row_number().over(inside) - 1
    )
    ends = [sum(quotas[: s + 1]) for s in range(shards)]
    shard = reduce(lambda c, s: F.when(F.col("_rank") < ends[s], s).otherwise(c), range(shards - 2, -1, -1), F.lit(shards - 1))
    first_of = [e - q for e, q in zip(ends, quotas)]
    placed = ranked.withColumn("shard", shard.cast("int"))
    slot = F.col("_rank") - _by_shard(first_of, F.col("shard"))
    return placed.select("doc_id", "text_hash", "size", "text_crc32", "shard", slot.cast("bigint").alias("slot"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """docs with shard and slot, all columns kept; equal rows share a key and get its places in some order.

    Columns of docs named shard and slot are replaced.
    """
    assigned = saved(assign(docs, shards, rounds).select("doc_id", "text_hash", "shard", "slot"))
    places = assigned.select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
        F.coalesce("text_hash", F.lit(0)).alias("_hash"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"),
    )
    key = ["_id", "_none", "_hash"]
    placed = places.withColumn("_i", F.row_number().over(W.partitionBy(*key).orderBy("_shard", "_slot")))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_none"),
        F.xxhash64(F.col("text").cast("string")).alias("_hash"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_order"),
    )
    marked = marked.withColumn("_i", F.row_number().over(W.partitionBy(*key).orderBy("_order")))
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    joined = marked.join(placed, [*key, "_i"])
    return joined.select(*kept, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def op8_digest(placed: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
