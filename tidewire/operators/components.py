"""Connected components: contraction to least neighbours, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds are logarithmic in the number of nodes; this many are never needed.
MOST_ROUNDS = 60
#: Contraction goes on while a step leaves at most this share of the edges.
SHRINKS = 0.5


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _contracted(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes with their least neighbour or themselves (node, up), and the edges (a > b) between these that are left.

    What is connected stays connected, as every node is joined to its ``up``, and the least node of all is its own.  A hub that
    follows all it holds is contracted with what only it holds, and nothing of that is shuffled again.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.col("b").alias("up")))).alias("e")).select("e.*")
    ups = cut(ends.groupBy("node").agg(F.min("up").alias("up")))
    moved = edges.join(ups.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(ups.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
    left = moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return ups, cut(left)


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) for every node of undirected edges (a, b); component is the least node reachable.

    ``cut`` checkpoints a frame.  Self loops give a component of one node; null ends are ignored;
    no edges give no rows.  Nothing but counts and a checksum reaches the driver.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    state = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    levels, size, left = [], None, state.count()
    while left and (size is None or left <= SHRINKS * size):
        size = left
        ups, state = _contracted(state, cut)
        levels.append(ups)
        left = state.count()
    found = _stars(state, cut) if left else None
    for ups in reversed(levels):
        if found is None:
            found = ups.select("node", F.col("up").alias("component"))
        else:
            found = ups.join(found.select(F.col("node").alias("up"), "component"), "up", "left").select("node", F.coalesce("component", "up").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")) if found is None else found


def _stars(state: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) for the nodes of distinct edges (a > b)."""
    seen = None
    for _ in range(MOST_ROUNDS):
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        state = cut(_small_star(_large_star(state)))
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    found = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
