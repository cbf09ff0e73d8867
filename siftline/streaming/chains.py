"""Events that a chain of "next one at least so much later" passes, without one task for a key.

Which event follows an event, if it passes, depends on the two times only.  So every event gets a pointer to the first one
at least ``gap`` later, found by merging events and the times they wait for in one range-partitioned order; and the events
that pass are those which the pointers reach from the first event of each key.  Pointers double on the way up, each time
only those of events that the last ones lead to, which are ever fewer as chains run together; on the way down each event
that is known to pass names the one half as far on.  A key with any number of events takes as many rounds as its chain's
length has binary digits, each a join over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.broadcasts import small
from siftline.scratch import dropped, stored


def next_events(events: DataFrame, gap: int) -> DataFrame:
    """key, n, nxt: for events (key, n from 1 in order, t) the number of the first one of the key at ``t + gap`` or later, if any."""
    own = events.select("key", F.col("t").alias("at"), F.lit(1).alias("kind"), F.col("n").alias("event"), F.lit(None).cast("long").alias("asker"))
    waits = events.select("key", (F.col("t") + gap).alias("at"), F.lit(0), F.lit(None).cast("long"), F.col("n"))
    order = [F.col("key").asc_nulls_first(), "at", "kind", "event"]
    merged = stored(own.unionAll(waits).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "merged")
    placed = merged.withColumn("part", F.shiftright("_at", 33))
    # backwards: a frame that ends with its partition is added up anew for every row
    after = W.partitionBy("part", "key").orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = placed.withColumn("nxt", F.min("event").over(after))
    # where a partition has no event after, the first one of the key in a later partition is next: a row for each part
    heads = placed.groupBy("key", "part").agg(F.min("event").alias("head"))
    later = W.partitionBy("key").orderBy("part").rowsBetween(1, W.unboundedFollowing)
    beyond = stored(heads.withColumn("beyond", F.min("head").over(later)).select(F.col("key").alias("k"), F.col("part").alias("p"), "beyond"), "heads")
    asked = here.where("asker IS NOT NULL").join(small(beyond, 64), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    return asked.select("key", F.col("asker").alias("n"), F.coalesce("nxt", "beyond").alias("nxt")).where("nxt IS NOT NULL")


def reached(jumps: DataFrame, heads: DataFrame) -> DataFrame:
    """x: what ``jumps`` (x, y) lead to from ``heads`` (x), those included; a jump never leads back."""
    levels, heads = [stored(jumps, "jumps")], stored(heads, "heads")
    while True:
        last = levels[-1]
        entered = last.select(F.col("y").alias("x")).unionAll(heads).distinct()
        onward = last.select(F.col("x").alias("y"), F.col("y").alias("z"))
        twice = stored(last.join(entered, "x", "left_semi").join(onward, "y").select("x", F.col("z").alias("y")), "jumps")
        if twice.isEmpty():
            break
        levels.append(twice)
    found = heads
    for level in reversed(levels):
        found = found.join(level, "x", "left").select(F.explode(F.array_compact(F.array("x", "y"))).alias("x"))
    found = stored(found, "reached")
    dropped(jumps.sparkSession, *levels, twice, heads)
    return found


def passes(df: DataFrame, *, key: str, ts: str, order: list[str], gap: float) -> DataFrame:
    """ST3: ``df`` with ``passed``: each key's first event passes, then always the first one ``gap`` seconds or more later.

    Times count in whole microseconds; equal times are in the given order.  Null keys are one key, null times are an
    error of the caller.  Without a gap all events pass.  No rows give no rows.
    """
    if gap <= 0:
        return df.withColumn("passed", F.lit(True))
    micros = F.round(F.col(ts) * 1_000_000).cast("long")
    by = [F.col(key).asc_nulls_first(), *(F.col(c) for c in ("_t", *order))]
    ranked = stored(df.withColumn("_t", micros).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_n", F.monotonically_increasing_id()), "ranked")
    # of equal times the first event alone can pass
    events = stored(ranked.groupBy(F.col(key).alias("key"), F.col("_t").alias("t")).agg(F.min("_n").alias("n")), "events")
    jumps = next_events(events, round(gap * 1_000_000)).select(F.col("n").alias("x"), F.col("nxt").alias("y"))
    found = reached(jumps, events.groupBy("key").agg(F.min("n").alias("x")).select("x"))
    hit = found.select(F.col("x").alias("_n"), F.lit(True).alias("_hit"))
    return ranked.join(hit, "_n", "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_hit", F.lit(False)).alias("passed"))
