"""Exact set-similarity joins: pairs of sets whose Jaccard similarity reaches a threshold, none lost.

Members have one global order, the rarest first.  Two sets of n and m members that are as similar as asked share a member
within the first ``n - ceil(t n) + 1`` of each (prefix filter), their sizes differ little (bands), what follows the first
shared member bounds what they can share (positional filter), and the parity bitmaps of their members differ in no
more bits than the sets differ in members (bitmap filter).  All of these are bounds, so the few pairs that pass them are
compared whole and no others need be.

Prefix members are the join's keys, with the band of the size: only sets of neighbouring bands meet.  A key with more than
``HOT`` sets is dealt over several tasks: one side in parts, the other side to each part.

Components (:func:`similar_components`) need no keys: in texts of one language nearly all sets share prefix members, so
that rows met by key outgrow the input.  Bitmaps meet by blocks of neighbouring sizes there (:mod:`siftline.operators.blocks`).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.broadcasts import small
from siftline.functions.text import shingle_set
from siftline.operators.blocks import bitmaps, candidates, parity
from siftline.operators.components import components
from siftline.scratch import stored

#: 64-bit words of a bitmap; sets of one key that one task meets; candidates of a set that are compared in the first
#: round of components, and in the second.
WORDS, HOT, HUBS, FAT = 16, 2000, 1, 16
#: Allowance for rounding in bounds: a bound is only ever taken too wide.
EPS = 1e-9


def sketch(text: Column, own_size: int = 3, empty: bool = False) -> Column:
    """struct(grams, bits): a text's distinct 3-character shingles as sorted numbers, and their parity bitmap."""

    @F.arrow_udf("struct<grams:array<bigint>,bits:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        grams = [shingle_set(t, own_size, empty) for t in texts.to_pylist()]
        lists = lambda parts: pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *parts]))
        return pa.StructArray.from_arrays([lists(grams), lists([parity(g, WORDS) for g in grams])], ["grams", "bits"])

    return run(text)


def needed(n: Column, m: Column, t: float) -> Column:
    """Members that sets of n and m must share at least."""
    return F.ceil((n + m) * (t / (1 + t)) - EPS)


def band(n: Column, t: float) -> Column:
    """Sizes of sets that may be linked lie in one band or in two that follow each other."""
    return F.floor(F.log(n) / float(-np.log(t)) + EPS).cast("int")


def prefixes(sets: DataFrame, t: float, counts: DataFrame | None = None) -> DataFrame:
    """g, i, n, rest, band, bits for the prefix of every set (i, grams, bits); ``rest`` counts from this member on.

    ``counts`` (g, c) orders the members, the rarest first; those of all sets together, if not given.
    """
    flat = sets.select("i", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    counts = stored(flat.groupBy("g").agg(F.count("*").alias("c")), "counts") if counts is None else counts
    placed = flat.join(small(counts, 24), "g", "left").withColumn("pos", F.row_number().over(W.partitionBy("i").orderBy(F.col("c").asc_nulls_first(), "g")))
    first = placed.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * t - EPS) + 1)
    return first.join(sets.select("i", "bits"), "i").select("g", "i", "n", (F.col("n") - F.col("pos") + 1).alias("rest"), band(F.col("n"), t).alias("band"), "bits")


def fits(t: float) -> Column:
    """Whether sets x and y may be linked, by sizes, positions and, where these leave it open, bitmaps."""
    must = needed(F.col("x.n"), F.col("y.n"), t)
    differ = sum((F.bit_count(F.get("x.bits", F.lit(k)).bitwiseXOR(F.get("y.bits", F.lit(k)))) for k in range(WORDS)), F.lit(0))
    sizes = F.least("x.n", "y.n") >= t * F.greatest("x.n", "y.n") - EPS
    return sizes & (F.least("x.rest", "y.rest") >= must) & (differ <= F.col("x.n") + F.col("y.n") - 2 * must)


def met(left: DataFrame, right: DataFrame, t: float, where: Column) -> DataFrame:
    """Rows x (of ``left``) and y (of ``right``) that share a prefix member and pass all bounds and ``where``.

    y's band is x's, or the next or last one; a key with many rows of ``left`` is dealt over several tasks.  The join is a
    sorted one: bitmaps repeat, so files are far smaller than rows and their size would call for a broadcast.
    """
    return _meeting(left, right, (-1, 0, 1), where & fits(t))


def met_once(rows: DataFrame, t: float, where: Column | None = None) -> DataFrame:
    """:func:`met` of ``rows`` with themselves, each pair once: y lies in x's band and has a larger i, or in the band below."""
    once = (F.col("x.band") != F.col("y.own")) | (F.col("x.i") < F.col("y.i"))
    return _meeting(rows, rows, (0, 1), once & fits(t) if where is None else once & where & fits(t))


def crowded_keys(posts: DataFrame) -> DataFrame:
    """g, band, parts: the keys with more than ``HOT`` sets and how many tasks take them."""
    return posts.groupBy("g", "band").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("g", "band", F.ceil(F.col("c") / HOT).cast("int").alias("parts"))


def _meeting(left: DataFrame, right: DataFrame, steps: tuple[int, ...], where: Column) -> DataFrame:
    crowded = stored(crowded_keys(left), "crowded")
    near = right.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array(*[F.col("own") + s for s in steps])))
    same = (F.col("x.g") == F.col("y.g")) & (F.col("x.band") == F.col("y.band"))
    if crowded.isEmpty():
        return left.alias("x").join(near.alias("y").hint("merge"), same & where)
    parts = F.coalesce("parts", F.lit(1))
    x = left.join(small(crowded, 24), ["g", "band"], "left").withColumn("part", F.pmod(F.xxhash64("i"), parts)).drop("parts")
    y = near.join(small(crowded, 24), ["g", "band"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).drop("parts")
    return x.alias("x").join(y.alias("y").hint("merge"), same & (F.col("x.part") == F.col("y.part")) & where)


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """i, j, jaccard of pairs (i of ``left``, j of ``right``); two empty sets are equal.

    Of the sets (written tables) only those of some pair move, packed.
    """
    pairs = stored(pairs.select("i", "j"), "pairs")
    asked = lambda k: small(stored(pairs.select(F.col(k).alias("i")).distinct(), "asked"), 16)
    a = left.join(asked("i"), "i", "left_semi").select("i", packed(F.col("grams")).alias("ga"))
    b = right.join(asked("j"), "i", "left_semi").select(F.col("i").alias("j"), packed(F.col("grams")).alias("gb"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", packed_jaccard(F.col("ga"), F.col("gb")).alias("jaccard"))


def packed(grams: Column) -> Column:
    """A set's sorted members as compressed differences, byte plane by byte plane: about two bytes a member."""

    @F.arrow_udf("binary")
    def run(sets: pa.Array) -> pa.Array:
        flat, at = members(sets)
        steps = (np.diff(flat[x:y], prepend=0) for x, y in zip(at[:-1], at[1:]))
        return pa.array([zlib.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for d in steps], pa.binary())

    return run(grams)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def packed_jaccard(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array([set_jaccard(unpacked(x.as_py()), unpacked(y.as_py())) for x, y in zip(one, two)], pa.float64())

    return run(a, b)


def set_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def members(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All lists' numbers and where each list begins and ends."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


def similar_pairs(sets: DataFrame, t: float) -> DataFrame:
    """I < j, jaccard for all pairs of ``sets`` (i, grams, bits; a written table) at or above ``t``."""
    posts = stored(prefixes(sets, t), "prefixes")
    pairs = met_once(posts, t).select(F.least("x.i", "y.i").alias("i"), F.greatest("x.i", "y.i").alias("j")).distinct()
    return compared(pairs, sets, sets).where(F.col("jaccard") >= t)


def similar_across(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """I, j, jaccard for all pairs of a set of ``left`` and one of ``right`` (written tables) at or above ``t``.

    Sets whose band is next to none of the other side are left out before they are taken apart.
    """
    bands = lambda df: df.select(band(F.size("grams"), t).alias("own")).distinct().select(F.explode(F.array(F.col("own") - 1, "own", F.col("own") + 1)).alias("band")).distinct()
    near = lambda df, other: df.withColumn("band", band(F.size("grams"), t)).join(F.broadcast(bands(other)), "band", "left_semi").drop("band")  # noqa: E731  bands are a few dozen
    one, two = near(left, right), near(right, left)
    counts = two.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    counts = stored(counts, "members")
    pairs = met(prefixes(two, t, counts), prefixes(one, t, counts), t, F.lit(True)).select(F.col("y.i").alias("i"), F.col("x.i").alias("j")).distinct()
    return compared(pairs, left, right).where(F.col("jaccard") >= t)


def similar_components(sets: DataFrame, t: float) -> DataFrame:
    """node, root: the components of all pairs at or above ``t``, roots left out, without making all pairs of a group.

    Every round compares the candidates of least distance that lie in different components, at most ``HUBS`` of a set in
    the first round, ``FAT`` in the second and all that are left in the third.  Only sets that candidates were left out
    of take part in the next round, so a large group of near copies costs a few candidates of each set.
    """
    maps = stored(bitmaps(sets, t), "bitmaps")
    active, root = maps.withColumn("c", F.col("i")), None
    for cap in (HUBS, FAT, None):
        met = stored(candidates(active, t, cap), "met")
        pairs, left = met.where("b IS NOT NULL"), met.where("b IS NULL").select(F.col("a").alias("i"))
        if cap is not None:
            ranked = stored(pairs.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy("score", "b"))), "ranked")
            pairs, over = ranked.where(F.col("place") <= cap), ranked.where(F.col("place") > cap)
            left = left.unionAll(over.select("a")).unionAll(over.select("b"))
        found = linked(pairs.select(F.col("a").alias("i"), F.col("b").alias("j")), sets, t)
        if root is None:
            root = components(found)
        elif not found.isEmpty():
            root = components(found.unionAll(root))
        if cap is None:
            return root
        left = stored(left.distinct(), "left")
        if left.isEmpty():
            return root
        of = left.join(root, F.col("i") == F.col("node"), "left").select("i", F.coalesce("root", "i").alias("c"))
        active = stored(maps.join(small(stored(of, "of"), 24), "i"), "active")


def linked(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """a, b: the met pairs that are similar enough, written."""
    once = pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    return stored(compared(once, sets, sets).where(F.col("jaccard") >= t).select(F.col("i").alias("a"), F.col("j").alias("b")), "links")


def best_match(pairs: DataFrame) -> DataFrame:
    """The pair of greatest similarity for each i; ties go to the smallest j."""
    by = W.partitionBy("i").orderBy(F.desc("jaccard"), "j")
    return pairs.withColumn("_b", F.row_number().over(by)).where("_b = 1").drop("_b")
