"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.runtime import Scratch

BROADCAST_EDGES = 200_000


def _large_star(e: DataFrame, ready: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tie each node's larger neighbours to the smallest of itself and all neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ready(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame, ready: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them. Edges have a > b."""
    least = ready(e.groupBy("a").agg(F.min("b").alias("m")))
    lower = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(node, label) for each node of edges (a long, b long): label is the smallest node of its component
    and each node that isn't a label has one row; labels themselves have none.

    Edges may repeat, point either way or be loops. Nulls take no part. Minima are taken before the shuffle. A step
    then joins edges with the minima of their nodes: those of a graph that is counted and has at most broadcast_edges
    edges (so twice as many minima at most) are broadcast; those of a larger one are a table, as only a join of two
    plain exchanges can split the edges of a node that has very many. Each round is a table in the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before, used = scratch.keep(e, "edges"), None, []

    def table(t: DataFrame, name: str) -> DataFrame:
        used.append(scratch.keep(t, name))
        return used[-1]

    for _ in range(max_rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        small, before = now[0] <= broadcast_edges, now
        used.append(e)
        ready = F.broadcast if small else lambda least: table(least, "least")
        e = _large_star(e, ready)
        e = scratch.keep(_small_star(e if small else table(e, "star"), ready), "edges")
        while used:
            scratch.drop(used.pop())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
