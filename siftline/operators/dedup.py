"""Near-duplicate removal: exact groups, exact similarity links, components, representatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.broadcasts import small
from siftline.functions.text import FEW, dedup_normal, shingle_set
from siftline.operators.setjoin import compared, similar_components
from siftline.scratch import bounded_batches, stored


def deduplicate(df: DataFrame, *, idx: str = "idx", text: str = "text", priority: Column | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``df``: idx, component, representative, kept, jaccard (to the representative; null if kept).

    Texts that are equal after normalising are one text (X3, X4); those whose shingles reach ``threshold`` are linked by an
    exact join (J5, J6, U5), and a component's representative is its row of highest priority, then smallest idx (A21).
    A removed row's similarity may lie below the threshold, because links chain.  Null texts count as empty.  Texts
    are told apart by two hashes and taken apart where they are read, so that none is written or moves.
    """
    joined, sets = decided(df, idx, text, priority, threshold)
    moved = joined.where("idx != representative AND i != j").select("i", "j").distinct()
    out = joined.join(compared(moved, sets, sets), ["i", "j"], "left")
    kept = F.col("idx") == F.col("representative")
    same = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.round("jaccard", 4))
    return out.select("idx", "component", "representative", kept.alias("kept"), F.when(~kept, same).alias("jaccard"))


def decided(df: DataFrame, idx: str, text: str, priority: Column | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """idx, component, representative and the ids i, j of their two texts, for every row; and the texts' sets.  Both are written."""
    bounded_batches(df.sparkSession)
    priority = F.lit(0.0) if priority is None else priority
    norm = dedup_normal(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(idx).cast("long").alias("i0"), priority.cast("double").alias("p"), norm.alias("norm"))
    hashed = rows.select("i0", "p", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("second"), "norm").alias("h2"), "norm")
    read = stored(hashed.mapInArrow(taken_apart, "i0 long, p double, h1 long, h2 long, grams array<long>"), "read")
    base = read.drop("grams")
    texts = stored(base.groupBy("h1", "h2").agg(F.min("i0").alias("i")), "texts")
    sets = one_set_each(read.where("i0 IS NOT NULL"), texts)
    roots = stored(similar_components(sets, threshold), "roots")
    owner = texts.join(roots, texts.i == roots.node, "left").select("h1", "h2", "i", F.coalesce("root", "i").alias("component"))
    rows = base.select("i0", "h1", "h2", "p").join(owner, ["h1", "h2"]).select(F.col("i0").alias("idx"), "i", "component", "p")
    best = rows.groupBy("component").agg(F.max_by(F.struct("idx", "i"), F.struct("p", -F.col("idx"))).alias("r"))
    return stored(rows.join(best, "component").select("idx", "i", "component", F.col("r.idx").alias("representative"), F.col("r.i").alias("j")), "rows"), sets


def decisions(df: DataFrame, *, idx: str = "idx", text: str = "text", priority: Column | None = None, threshold: float = 0.8) -> DataFrame:
    """:func:`deduplicate` without the similarities to representatives, which take the sets of all removed texts."""
    joined, _ = decided(df, idx, text, priority, threshold)
    return joined.select("idx", "component", "representative", (F.col("idx") == F.col("representative")).alias("kept"))


def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their shingles in place of the last column, the text; a few at a time, so that no worker holds many."""
    for batch in batches:
        for at in range(0, batch.num_rows, FEW):
            part = batch.slice(at, FEW)
            grams = [shingle_set(t) for t in part.column(part.num_columns - 1).to_pylist()]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, grams)], dtype=np.int32), np.concatenate(grams))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*part.schema.names[:-1], "grams"])


def one_set_each(read: DataFrame, texts: DataFrame) -> DataFrame:
    """i, grams (a written table): the set of every text, from the row that gives it its ``i``.

    Rows of other ids are left out where they are read if they are few (a checked size); so are, then, repeats of an id.
    """
    firsts = texts.select("h1", "h2", F.col("i").alias("i0"))
    others = stored(read.select("h1", "h2", "i0").join(firsts, ["h1", "h2", "i0"], "left_anti"), "others")
    kept = read.join(small(others, 32), ["h1", "h2", "i0"], "left_anti").select(F.col("i0").alias("i"), "grams")
    repeated = stored(read.groupBy("i0").count().where("count > 1").select(F.col("i0").alias("i")), "repeated")
    if repeated.isEmpty():
        return stored(kept, "sets")
    again = small(repeated, 16)
    once = kept.join(again, "i", "left_semi").dropDuplicates(["i"])
    return stored(kept.join(again, "i", "left_anti").unionAll(once), "sets")


def exact_groups(df: DataFrame, *, idx: str = "idx", text: str = "text") -> DataFrame:
    """first, size for each group of texts equal after normalising, of two rows or more."""
    norm = dedup_normal(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(norm.alias("norm")).agg(F.min(idx).alias("first"), F.count("*").alias("size")).where("size > 1").drop("norm")


def removal_summary(result: DataFrame) -> DataFrame:
    """Counts of a :func:`deduplicate` or :func:`decisions` result."""
    return result.agg(F.count("*").alias("total"), F.count_if(~F.col("kept")).alias("removed"), F.count_distinct("component").alias("components"))


def keep_first(df: DataFrame, *keys: str, order: Column) -> DataFrame:
    """distinct by keys, keeping the first row."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")
