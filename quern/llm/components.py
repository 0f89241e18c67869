"""Connected components by randomised contraction, in DataFrame functions.

Each round, every vertex of the remaining graph picks, of itself and its neighbours, the first in that
round's random order; edges are rewritten to the picks, loops and repeats go. The order is a keyed
permutation of the 64-bit ids, so that the pick is a minimum of one long, hashed and never sorted. A
constant expected share of the vertices goes each round, whatever the graph's diameter, and no
vertex's neighbour list is ever gathered: the pick is a partially aggregated minimum. The rounds'
picks are then composed from the last to the first. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.work import save


LOW = 0xFFFFFFFF


def shuffled(v: Column, seed: int) -> Column:
    """``v`` under a permutation of all longs: two Feistel rounds of 32-bit halves."""
    low = v.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(v, 32).bitwiseXOR(_mask(low, seed))
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseXOR(_mask(high, seed)))


def unshuffled(x: Column, seed: int) -> Column:
    """The v of which x is the shuffled value."""
    high = F.shiftrightunsigned(x, 32)
    low = x.bitwiseAND(F.lit(LOW)).bitwiseXOR(_mask(high, seed))
    return F.shiftleft(high.bitwiseXOR(_mask(low, seed)), 32).bitwiseOR(low)


def _mask(half: Column, seed: int) -> Column:
    return F.xxhash64(half, F.lit(seed)).bitwiseAND(F.lit(LOW))


def components(edges: DataFrame) -> DataFrame | None:
    """Edges (a, b), any direction, repeats and loops allowed → (node, root) for every node with an edge to another.

    None if there is no such edge.
    """
    picks: list[DataFrame] = []
    e = save(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    while not e.isEmpty():
        seed = len(picks)
        both = e.union(e.select("b", "a"))
        pick = both.groupBy("a").agg(F.min(shuffled(F.col("b"), seed)).alias("m"))
        pick = save(pick.select(F.col("a").alias("node"), unshuffled(F.least("m", shuffled(F.col("a"), seed)), seed).alias("to")), "picks")
        picks.append(pick)
        e = e.join(pick.withColumnRenamed("node", "a").withColumnRenamed("to", "pa"), "a").join(pick.withColumnRenamed("node", "b").withColumnRenamed("to", "pb"), "b")
        e = save(e.where(F.col("pa") != F.col("pb")).select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not picks:
        return None
    roots = picks[-1].select("node", F.col("to").alias("root"))
    for p in reversed(picks[:-1]):
        up = roots.select(F.col("node").alias("to"), "root")
        roots = p.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
