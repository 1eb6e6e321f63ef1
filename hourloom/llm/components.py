"""Connected components of a link table by alternating star rounds.

Every round rewrites the links so that each node hangs on a smaller neighbour; the links end as one
star per component around its smallest node. Rounds grow with the logarithm of the longest path.
Minima are aggregated map-side, first by (node, salt) and then by node, and joined back by (node, salt):
the links of a node with very many neighbours lie in SALTS parts, and there is never more than one
minimum a link to send back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.store import saved

SALTS = 256


def _salt(neighbour: str) -> Column:
    return F.pmod(F.xxhash64(neighbour), F.lit(SALTS)).cast("int")


def _lowest(links: DataFrame) -> DataFrame:
    """(u, m, salts): the smallest neighbour of each node and the salts of its links, SALTS at most."""
    parts = links.groupBy("u", _salt("v").alias("salt")).agg(F.min("v").alias("m"))
    return parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))


def _joined(links: DataFrame, low: DataFrame) -> DataFrame:
    """links with m, the minimum that low has for their u."""
    spread = low.select("u", "m", F.explode("salts").alias("salt"))
    return links.withColumn("salt", _salt("v")).join(spread, ["u", "salt"]).drop("salt")


def _outward(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to its smallest neighbour, or to itself if it is smaller."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).withColumn("m", F.least("m", "u"))
    return _joined(both.where(F.col("v") > F.col("u")), low).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _inward(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them; needs u > v."""
    low = _lowest(links)
    moved = _joined(links, low).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node except the roots; root is the smallest node of its component.

    Nulls, self links and repeated links are dropped; without links the result is empty.
    """
    small, large = F.least(a, b), F.greatest(a, b)
    state = saved(links.where(F.col(a) != F.col(b)).select(large.alias("u"), small.alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        state = saved(_inward(_outward(state).distinct()).distinct())
        mark = state.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))
        ).first()
        if mark == before or not mark[0]:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
