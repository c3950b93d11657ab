"""Connected components of an edge table, by alternating large-star and small-star rounds.

No vertex ever gathers its neighbours: each half round is a minimum per vertex (combined before
the shuffle) joined back to the edges, and that join starts from stored tables, so adaptive
execution can split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns ``id`` and ``component`` (the smallest id reachable) for each vertex of an edge.

    ``edges`` has long columns ``a`` and ``b``; self-loops, repeats, both directions and rows with
    a null are allowed. An empty table gives an empty table.
    """
    now = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        now = stored(
            joined.select("a", F.col("m").alias("b"))
            .unionAll(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
            .where("a != b")
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
