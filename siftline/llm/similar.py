"""Near-duplicates of Jaccard similarity 0.8 or more over word shingles: SimHash trees first, then a set join.

A text is the set of its shingles (``width`` words in a row, or the whole sequence if there are fewer).  Equal sets
are one class.  The classes' SimHash fingerprints go through the vantage-point trees of :mod:`simhash`; the edges that
these give are checked on the sets themselves.  A fingerprint of 64 bits differs in about ten bits at a similarity of
0.8, and at such a reach no triangle bound prunes, so the trees alone cannot find all links.  The rest comes from a
prefix-filtered join, which loses none:

All shingles have one order, the rarest first.  Two sets that are as similar as asked share a shingle within the
first ``n - ceil(t n) + 1`` of each.  Where a pair meets, its sizes and the number of shingles that come after bound
what the two can share; the bound holds at the first shingle that they share, so the pair is found there.

Members of a large group are not paired with one another.  In each round a class is checked against a few classes of
every group of equal prefix shingles, more in later rounds, and only if the two lie in different components so far.
The last round checks all pairs that are left between components.

How many texts have a shingle is counted over all of them; the most common ones are looked up while prefixes are
taken.  The table decides only how many pairs are checked, not which links are found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import shared_root, small, stash, trimmed, unstash
from siftline.llm.hashing import flat, mixed, slices, tokens
from siftline.llm.packed import BLOBS, blobs, merged, summed, unpack, unplanes
from siftline.llm.simhash import components, first_of_each, links

#: Common shingles that are kept at most (12 bytes each), bits of a shingle that are counted, shingles that a task
#: gathers before it sorts them.
COMMON, COUNTED, GATHER = 1_000_000, 40, 500_000
#: Bytes of text whose shingles are held at once; what is needed beside them is about 150 times this.
AT_ONCE = 1 << 18
#: The similarity of a link, as a fraction.
PART, WHOLE = 4, 5
#: Classes of a group that every other is checked against, by round.
HUBS = (8, 64)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted in each text, and each text's first one, plus the end."""
    h, at = tokens(*flat(texts))
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    many = max(len(h) - width + 1, 0)
    g = np.zeros(many, np.uint64)
    for i in range(width if many else 0):
        g = mixed(g * np.uint64(31) + h[i : i + many])
    inside = np.arange(many) + width <= at[1:][doc[:many]]
    g, doc = g[inside], doc[:many][inside]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for i in range(width - 1):
            some = n[few] > i
            whole[some] = mixed(whole[some] * np.uint64(31) + h[at[few[some]] + i])
        g, doc = np.concatenate([g, mixed(whole + n[few].astype(np.uint64))]), np.concatenate([doc, few])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def set_keys(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set of shingles, 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(g ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(at).astype(np.uint64)
    return np.where(n > 0, mixed(sums[at[1:]] - sums[at[:-1]] + n), np.uint64(0))


def set_fingerprints(g: np.ndarray, at: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The SimHash of each set: a bit is 1 if it is set in over half of the shingles."""
    n = np.diff(at)
    ones, doc = np.zeros((len(n), 64), np.int64), np.repeat(np.arange(len(n)), n)
    for a in range(0, len(g), step):
        bits, of = np.unpackbits(g[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), doc[a : a + step]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))


def sets(rows: DataFrame, width: int) -> DataFrame:
    """k (number of the set), g (its shingles) for each row's text."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, n in slices(texts, AT_ONCE):
                g, at = shingles(texts.slice(a, n), width)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(g, at).view(np.int64)), lists(g, at)], ["k", "g"])

    return rows.select("text").mapInArrow(trimmed(run), "k long, g array<long>")


def common_shingles(rows: DataFrame, width: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` common shingles (their top bits, sorted) and how many texts have them; all texts are counted.

    Counts move as sorted arrays.  A shard holds about half of what a partition of ``rows`` has.
    """
    bits = min(20, (2 * rows.rdd.getNumPartitions()).bit_length())
    cut, shard_cut = np.uint64(64 - COUNTED), np.uint64(COUNTED - bits)
    step = lambda c: np.minimum(255, np.log2(np.maximum(c, 1)) * 4).astype(np.int64)  # noqa: E731  four steps for each doubling

    def count(batches):
        held, size = [], 0

        def out():
            keys, counts = summed(np.concatenate(held))
            held.clear()
            return blobs((keys >> shard_cut).astype(np.int32), keys, counts)

        for batch in batches:
            texts = batch.column("text")
            for a, n in slices(texts, AT_ONCE):
                g = shingles(texts.slice(a, n), width)[0] >> cut
                held.append(g)
                if (size := size + len(g)) > GATHER:
                    yield out()
                    size = 0
        if size:
            yield out()

    def add(table):
        keys, counts = merged(table)
        keys, counts = keys[counts > 2], counts[counts > 2]
        by = np.bincount(step(counts), minlength=256)
        packed = blobs(np.zeros(len(keys), np.int32), keys, counts)
        one = lambda name: packed.column(name)[0].as_py() if len(keys) else b""
        return pa.table({"steps": pa.array([by.tolist()], pa.list_(pa.int64())), "keys": pa.array([one("keys")], pa.binary()), "counts": pa.array([one("counts")], pa.binary())})

    counted = stash(rows.select("text").mapInArrow(trimmed(count), BLOBS).groupBy("shard").applyInArrow(add, "steps array<long>, keys binary, counts binary"), "common")
    steps = counted.select(F.posexplode("steps").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n")).collect()
    of = np.zeros(257, np.int64)
    for r in steps:
        of[r.step] = r.n
    least = int(np.flatnonzero(np.cumsum(of[::-1])[::-1] <= most)[0])

    def top(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                x, c = unpack(keys), unplanes(counts, np.uint64)
                often = step(c) >= least
                yield pa.RecordBatch.from_arrays([pa.array([x[often].tobytes()]), pa.array([np.minimum(c[often], 0xFFFFFFFF).astype(np.uint32).tobytes()])], ["x", "c"])

    found = counted.mapInArrow(top, "x binary, c binary").collect()  # ``most`` entries of 12 bytes at most
    unstash(rows.sparkSession, counted)
    x = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.x, np.uint64) for r in found)])
    c = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r.c, np.uint32) for r in found)])
    order = np.argsort(x)
    return x[order], c[order]


def prefixes(rows: DataFrame, width: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """d, h, k (number of the set), n (its size), fp (fingerprint), p (the shingles of its prefix); one row per row."""
    held = rows.sparkSession.sparkContext.broadcast(common)
    cut = np.uint64(64 - COUNTED)

    def run(batches):
        known, count = held.value
        for batch in batches:
            texts = batch.column("text")
            for a, m in slices(texts, AT_ONCE):
                g, at = shingles(texts.slice(a, m), width)
                n = np.diff(at)
                seen = np.zeros(len(g), np.uint32)
                if len(known):
                    i = np.minimum(np.searchsorted(known, g >> cut), len(known) - 1)
                    seen = np.where(known[i] == g >> cut, count[i], np.uint32(0))
                doc = np.repeat(np.arange(m), n)
                order = np.lexsort((g, seen, doc))
                size = np.where(n > 0, n - -(-PART * n // WHOLE) + 1, 0)
                first = np.arange(len(g)) - np.repeat(at[:-1], n) < np.repeat(size, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("d").slice(a, m),
                        batch.column("h").slice(a, m),
                        pa.array(set_keys(g, at).view(np.int64)),
                        pa.array(n, pa.int64()),
                        pa.array(set_fingerprints(g, at).view(np.int64)),
                        lists(g[order][first], np.concatenate([[0], np.cumsum(size)])),
                    ],
                    ["d", "h", "k", "n", "fp", "p"],
                )

    return rows.mapInArrow(trimmed(run), "d long, h long, k long, n long, fp long, p array<long>")


def checked(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough."""
    both = pairs.join(held.select(F.col("k").alias("a"), F.col("g").alias("ga")), "a").join(held.select(F.col("k").alias("b"), F.col("g").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(WHOLE * shared >= PART * (F.size("ga") + F.size("gb") - shared)).select("a", "b")


def may_link(n: Column, rest: Column, m: Column, left: Column) -> Column:
    """Whether sets of ``n`` and ``m`` shingles can be linked if they first meet where ``rest`` and ``left`` are to come.

    A link needs 4 (n + m) / 9 common shingles or more, all of them among those.
    """
    return (PART * F.greatest(n, m) <= WHOLE * F.least(n, m)) & ((PART + WHOLE) * F.least(rest, left) >= PART * (n + m))


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def tree_pairs(classes: DataFrame, reach: int) -> DataFrame:
    """a, b: classes (k, fp) of one fingerprint with its first, and first ones that the vantage-point trees link."""
    prints = stash(classes.groupBy("fp").agg(F.min("k").alias("first")), "fingerprints")
    same = classes.join(prints, "fp").where("k != first").select(F.col("first").alias("a"), F.col("k").alias("b"))
    edges = links(prints.select("fp"), reach)
    ends = edges.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.unionAll(ends.select(*ordered("x", "y"))).distinct()


def hub_pairs(live: DataFrame, hubs: int) -> DataFrame:
    """a, b: members (s, k, n, rest, c) with ``hubs`` members of the same shingle, where the components c differ."""
    drawn = W.partitionBy("s").orderBy(F.xxhash64("k", "s", F.lit(hubs)), "k")
    hub = stash(live.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= hubs).select("s", F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("c").alias("c2")), "hubs")
    met = live.join(small(hub, 64), "s").where((F.col("c") != F.col("c2")) & may_link(F.col("n"), F.col("rest"), F.col("n2"), F.col("rest2")))
    return met.select(*ordered("k", "k2")).distinct()


def open_pairs(live: DataFrame) -> DataFrame:
    """a, b: all pairs of members that share a shingle and lie in different components.

    Components meet first, by bounds over their members of the shingle, so that members of one are not paired.
    """
    cell = stash(live.groupBy("s", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest")), "cells")
    other = cell.select("s", *(F.col(x).alias(x + "2") for x in ("c", "lo", "hi", "rest")))
    sizes = (PART * F.col("lo") <= WHOLE * F.col("hi2")) & (PART * F.col("lo2") <= WHOLE * F.col("hi"))
    across = cell.join(other, "s").where((F.col("c") < F.col("c2")) & sizes & ((PART + WHOLE) * F.least("rest", "rest2") >= PART * (F.col("lo") + F.col("lo2")))).select("s", "c", "c2")
    a = live.select("s", "c", F.col("k").alias("ka"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    b = live.select("s", F.col("c").alias("c2"), F.col("k").alias("kb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    met = across.join(a, ["s", "c"]).join(b, ["s", "c2"]).where(may_link(F.col("na"), F.col("ra"), F.col("nb"), F.col("rb")))
    return met.select(*ordered("ka", "kb")).distinct()


def groups(docs: DataFrame, *, width: int = 5, reach: int = 3, hubs: tuple[int, ...] = HUBS) -> DataFrame:
    """d, h (hash of the text), root: one row per row of ``docs`` (doc_id, text), its component's number as root.

    Links are all pairs of texts whose shingle sets have a Jaccard similarity of 0.8 or more; texts without words
    (null, empty, blank) are equal.  Ids may be null or repeated, other columns are ignored, no rows give none.
    """
    spark, rows = docs.sparkSession, text_rows(docs)
    shared_root(spark)
    signed = stash(prefixes(rows, width, common_shingles(rows, width)), "prefixes")
    posted = signed.dropDuplicates(["k"]).select("k", "n", F.posexplode("p").alias("pos", "s")).select("s", "k", "n", (F.col("n") - F.col("pos")).alias("rest"))
    shared = stash(posted.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s"), "shared")
    met = stash(posted.join(small(shared, 24), "s"), "met")
    unstash(spark, shared)

    # one text of each set that takes part
    classes = stash(signed.join(met.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.min("h").alias("h"), F.min("fp").alias("fp")), "classes")
    held = stash(sets(rows.join(small(classes.select("h"), 16), "h", "left_semi"), width).dropDuplicates(["k"]), "sets")

    done = stash(tree_pairs(classes.select("k", "fp"), reach), "pairs")
    root = components(stash(checked(done, held), "links"))
    for many in (*hubs, None):
        member = met.join(root, met.k == root.node, "left").select("s", "k", "n", "rest", F.coalesce("root", "k").alias("c"))
        split = member.groupBy("s").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("s")
        live = stash(member.join(split, "s", "left_semi"), "live")
        pairs = stash((hub_pairs(live, many) if many else open_pairs(live)).join(done, ["a", "b"], "left_anti"), "pairs")
        done = done.unionAll(pairs)
        root = components(stash(checked(pairs, held), "links").unionAll(root.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        unstash(spark, live)
    unstash(spark, met, held, classes)
    return signed.join(root, signed.k == root.node, "left").select("d", "h", F.coalesce("root", "k").alias("root"))


def keep_one_similar(docs: DataFrame, **options) -> DataFrame:
    """The row of the smallest id of each component of :func:`groups`, with all columns of ``docs``; one row of repeats."""
    return first_of_each(docs, groups(docs, **options))
