"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed; each round is two grouped minima and joins, and its
result is checkpointed.  A hub's edges are pre-aggregated before the shuffle
and its join is split by adaptive skew handling.  The rounds end when the
forest no longer changes, compared by count and an order-free checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstar.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a > b): link neighbours to the smallest one of the neighbourhood."""
    if large:  # neighbours on both sides; only larger ones move
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # smaller neighbours only
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge to another node.

    Null ends and loops are ignored; repeated edges count once.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x.isNotNull() & y.isNotNull() & (x != y))
              .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    state = _state(now)
    while state[0]:
        now = cut(_star(_star(now, large=True), large=False))
        new = _state(now)
        if new == state:
            break
        state = new
    # stars: every edge points at its component's smallest node
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
