"""Ranks and orders that do not need one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.broadcasts import small
from siftline.scratch import stored


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds the 1-based rank of each row in a total order.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the sizes of the
    partitions before it, of which there are as many as tasks.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each partition
    return out.withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def group_rank(df: DataFrame, keys: list[str], *order: Column, name: str = "rank", size: str | None = None) -> DataFrame:
    """Adds the 1-based rank of each row in its group, and with ``size`` the group's number of rows.

    What ``row_number`` over the keys gives, but no task holds a group: rows are range-partitioned by keys and order, so a
    large group lies in many partitions, and a row's rank is its place in its partition plus what partitions before
    hold of the group.  Only a row for each group and partition meets in windows.  Null keys are a group.  Rows that
    are equal in keys and order are told apart as they lie.
    """
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    at = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = at.withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    pieces = placed.groupBy(F.col("_part").alias("_p"), *own).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    group = W.partitionBy(*names)
    shifts = pieces.select("_p", *names, (F.sum("_n").over(group.orderBy("_p")) - F.col("_n") - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(group).alias("_size"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.join(small(stored(shifts, "shifts"), 64), same)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in (name, size)], (F.col("_place") + F.col("_shift")).alias(name), *([F.col("_size").alias(size)] if size else []))


def group_percentiles(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Keys, n, mean, at: number and mean of the group's values, and linear interpolation at ``q * (n - 1)`` of them in order.

    Exact, from ranks of :func:`group_rank`: no group is gathered in one row or task.  Null values do not count; a group of
    nothing else gives no row.
    """
    ranked = group_rank(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), keys, F.col("_v").asc(), name="_r", size="_s")
    at = q * (F.col("_s") - 1)
    low, high = (F.max(F.when(F.col("_r") - 1 == f(at), F.col("_v"))) for f in (F.floor, F.ceil))
    found = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), low.alias("_low"), high.alias("_high"))
    left = q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))
    return found.select(*keys, "n", "mean", (F.col("_low") + (F.col("_high") - F.col("_low")) * left).alias("at"))


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def newest(df: DataFrame, n: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The ``n`` newest rows, newest first; of equal times the later arrival first."""
    return df.orderBy(F.desc(ts), F.desc(seq)).limit(n)


def interleaved(df: DataFrame, group: str, *order: Column, name: str = "seq") -> DataFrame:
    """Round robin: every group's first row, then every group's second, and so on; groups by their first row."""
    ranked = group_rank(df, [group], *order, name="_k")
    lead = ranked.where("_k = 1").select(F.col(group).alias("_of"), F.struct(*order).alias("_g"))
    met = ranked.join(small(lead, 256), F.col(group).eqNullSafe(F.col("_of")))
    return global_rank(met, F.col("_k"), F.col("_g"), F.col(group), name=name).drop("_k", "_g", "_of")
