"""Connected components by alternating large-star and small-star steps.

Both steps are a group-by and a join on nodes; the number of rounds grows with the logarithm of the longest path.
Each round is written below the session's shared folder and read back, so that neither lineage nor lost executors
matter; what the round before wrote is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.scratch import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b) but the roots; root is the smallest node it is linked with."""
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(hung.unionAll(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "small-star")
        dropped(edges.sparkSession, now, large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    low = F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))
    return tuple(edges.agg(F.count("*"), F.sum(low)).first())
