"""Connected components by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, join_by_size, materialise

#: Far beyond the logarithm of any path's length; more rounds are an error.
MAX_ROUNDS = 40


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node that is linked to it.

    Each round hangs the larger neighbours of a node on its least neighbour, then
    the smaller ones; paths shrink by a constant factor, so rounds grow with the
    logarithm of the longest path. A node's neighbours are never gathered: its
    least neighbour is an aggregate that is joined back, by broadcast for the few
    nodes that have very many. Loops and repeated edges are allowed; no edges
    give no rows. Raises RuntimeError if MAX_ROUNDS rounds don't suffice.
    """
    current = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hang(both, 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct(), "edges")
        small = _hang(large, 2 * state[0])
        own = small.select("a", F.col("m").alias("b"))
        others = small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = current
        current = materialise(own.unionByName(others).filter("a <> b").distinct(), "edges")
        discard(old, large)
    else:
        raise RuntimeError(f"the components are not complete after {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _hang(edges: DataFrame, total: int) -> DataFrame:
    """(a, b, m): m is the least of a and all its b."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return join_by_size(edges, least, ["a"], "n", total).select("a", "b", "m")
