"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_stored, store


#: So many edges have minima (two nodes each, 16 bytes a node) that are broadcast.
BROADCAST_EDGES = 200_000


def _beside(least: DataFrame, edges: int) -> DataFrame:
    """Minima to join with edges: broadcast if few, so a hub's edges stay where they lie; else
    stored, so that the join's two sides are shuffled and a hub's part can be split."""
    return F.broadcast(least) if edges <= BROADCAST_EDGES else store(least, "minima")


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component is its smallest node.

    A large-star step links each larger neighbour of a node with the smallest of
    its neighbourhood, a small-star step does so with the smaller ones; both keep
    connectivity, and the rounds end when the edges are stars around minima. Every
    round is stored in the shared folder, so lineage stays short and nothing but
    a count and a checksum reaches the driver. Nulls and loops link nothing;
    repeated edges count once; an empty table has no components."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    e = store(e.where(F.col("a").isNotNull() & F.col("b").isNotNull()), "stars", slim=True)
    seen = _sum(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(_beside(least, seen[0]), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(_beside(least, 2 * seen[0]), "a")
        nxt = store(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a > b").distinct(), "stars", slim=True)
        now = _sum(nxt)
        drop_stored(e)
        e = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
