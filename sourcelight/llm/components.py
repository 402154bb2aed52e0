"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelight.llm import common


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``id`` and ``component`` (the least id reachable) for every id in ``links`` (columns ``a`` and ``b``).

    Alternating star contractions: first every node sends its greater neighbours to its least one, then its smaller
    ones, until nothing changes. Every round is written to the shared folder; the number of rounds goes with the
    logarithm of the longest chain. A node's neighbours are never gathered: only minima per node are.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    state = common.stored(pairs)
    before = None
    for _ in range(most_rounds):
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: node, b: neighbour
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        large = common.stored(large.filter("a <> b"))
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("to"), "a", "b")
        state = common.stored(small.select(F.col("to").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct())
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("links did not contract")
    roots = state.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return state.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)
