"""SimHash near-duplicates with vantage-point trees.

Equal fingerprints are one class.  Classes are dealt into shards by a vantage-point tree: each inner node has a
vantage fingerprint and a radius, and a class lives in the inner or the outer branch by its Hamming distance to
the vantage.  If two linked classes part at a node, the outer one lies within the link distance of the sphere;
it is also sent, as a guest, into the inner branch, and follows every branch below that the triangle inequality
leaves open.  So each linked pair meets in the shard where one of the two lives, and no pair is lost.

Inside a shard the tree goes on in memory with the same bounds down to blocks that are compared whole.  A shard
returns the edges of a spanning forest, at most one for each of its rows, never all pairs of a group.  Components
then come from alternating large-star and small-star steps over these edges.

The top tree is built from a bounded sample of classes; it decides only how evenly classes are dealt, not which
links are found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import shared_root, stash, unstash

BLANKS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Classes that a shard should hold, and that a block of a shard's own tree holds at most.
SHARD, BLOCK = 8192, 512
#: Fingerprints from which the top tree is built; it has at most 2 ** DEPTH shards.
SAMPLE, DEPTH = 65_536, 16


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """d, fp (the 64-bit fingerprint as a signed long), h (hash of the text); one row per row of ``docs``.

    Shingles are ``width`` words in a row, or the whole sequence if there are fewer; without words (null, empty,
    blank) the fingerprint is 0.  Texts of any length are summed piece by piece.
    """

    def sums(words: list[bytes]) -> tuple[np.ndarray, int]:
        from xxhash import xxh64_intdigest as xxh

        if len(words) < width:
            parts, total = ([b" ".join(words)] if words else []), 1 if words else 0
        else:
            parts, total = map(b" ".join, zip(*(words[i:] for i in range(width)))), len(words) - width + 1
        h = np.fromiter((xxh(p, 42) for p in parts), np.uint64, total)
        out = np.zeros(64, np.int64)
        for a in range(0, total, 100_000):
            out += np.unpackbits(h[a : a + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return out, total

    def run(batches):
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for i, t in enumerate(batch.column("text")):
                ones, total = sums(t.as_buffer().to_pybytes().translate(BLANKS).split())
                fps[i : i + 1] = np.packbits(2 * ones > total, bitorder="little").view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(fps.view(np.int64)), batch.column("h")], ["d", "fp", "h"])

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "d long, fp long, h long")


def distance(a, b):
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree as arrays: vantage, radius, and for each node its inner child (the outer is next)."""

    def __init__(self, sample: np.ndarray, shards: int, seed: int = 5):
        rng, self.vantage, self.radius, self.inner = np.random.default_rng(seed), [], [], []
        self.leaves = 0
        waiting = [(self._new(), sample, shards)]
        while waiting:
            node, points, want = waiting.pop()
            v = points[rng.integers(len(points))] if want > 1 and len(points) > 3 else None
            d = distance(points, v) if v is not None else None
            radius = int(np.median(d)) if v is not None else 0
            if v is None or (near := d <= radius).all():
                self.radius[node], self.inner[node] = -1, self.leaves
                self.leaves += 1
                continue
            self.vantage[node], self.radius[node], self.inner[node] = v, radius, self._new()
            self._new()
            waiting += [(self.inner[node], points[near], want // 2), (self.inner[node] + 1, points[~near], want - want // 2)]
        self.vantage = np.array(self.vantage, np.uint64)

    def _new(self) -> int:
        self.vantage.append(0), self.radius.append(0), self.inner.append(0)
        return len(self.inner) - 1

    def route(self, points: np.ndarray, reach: int):
        """(leaf, rows of ``points``, whether they live there) for homes and guests."""
        waiting = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while waiting:
            node, rows, home = waiting.pop()
            if not len(rows):
                continue
            if self.radius[node] < 0:
                yield self.inner[node], rows, home
                continue
            inner, outer, stays = split(distance(points[rows], self.vantage[node]), self.radius[node], home, reach)
            waiting += [(self.inner[node], rows[inner], stays[inner]), (self.inner[node] + 1, rows[outer], home[outer])]


def split(d: np.ndarray, radius: int, home: np.ndarray, reach: int):
    """Masks of what goes to the inner and to the outer branch, and what of the inner branch lives there."""
    d = d.astype(np.int16)
    near = d <= radius
    inner = near | (d <= radius + reach)
    outer = ~near | (~home & (d > radius - reach))
    return inner, outer, home & near


class Forest:
    """Union-find over 0 .. n-1 that takes many links at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = self.parent[up]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each round hangs the larger root of every pair below the smallest root that it meets."""
        while True:
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(fp: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between what lives in a shard and all that is in it."""
    forest, rng = Forest(len(fp)), np.random.default_rng(len(fp))
    waiting = [(np.arange(len(fp)), home)]
    while waiting:
        rows, lives = waiting.pop()
        own = rows[lives]
        if not len(own):
            continue
        d = distance(fp[rows], fp[own[rng.integers(len(own))]]) if len(own) > BLOCK else None
        if d is not None and not ((near := d[lives] <= (radius := int(np.median(d[lives])))).all() or not near.any()):
            inner, outer, stays = split(d, radius, lives, reach)
            waiting += [(rows[inner], stays[inner]), (rows[outer], lives[outer])]
            continue
        for a in range(0, len(own), BLOCK):
            part = own[a : a + BLOCK]
            for b in range(0, len(rows), 4 * BLOCK):
                other = rows[b : b + 4 * BLOCK]
                i, j = np.nonzero(distance(fp[part][:, None], fp[other][None, :]) <= reach)
                forest.link(part[i], other[j])
    top = forest.roots(np.arange(len(fp)))
    child = np.flatnonzero(top != np.arange(len(fp)))
    return fp[child], fp[top[child]]


def links(classes: DataFrame, reach: int = 3, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between fingerprints: their components are those of all pairs within ``reach`` bits.

    ``classes`` are distinct fingerprints (fp), a written table.
    """
    n = classes.count()
    want = min(1 << DEPTH, -(-n // shard))
    sample = [r[0] for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()] if want > 1 else []
    tree = Tree(np.array(sample, np.int64).view(np.uint64), want)  # goes with the function: at most 2 ** 17 nodes

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for leaf, rows, home in tree.route(fp, reach):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf), pa.int32()), pa.array(fp[rows].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def meet(_, table):
        a, b = shard_links(table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(), reach)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = classes.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes with an edge, root itself left out.

    Alternating large-star and small-star steps; each is written, so no lineage builds up.
    """
    spark = edges.sparkSession
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())
    now = stash(edges.where("a != b").distinct(), "edges")
    seen = sign(now)
    while seen[0]:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stash(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        after = stash(small.where("a != b").distinct(), "small-star")
        unstash(spark, now, large)
        now, before, seen = after, seen, sign(after)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(docs: DataFrame, *, reach: int = 3, shard: int = SHARD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, fp, h, root (the smallest fingerprint of its component); one row per row of ``docs``."""
    shared_root(docs.sparkSession)
    signed = stash(fingerprints(docs, doc_id=doc_id, text=text), "fingerprints")
    classes = stash(signed.select("fp").distinct(), "classes")
    root = components(links(classes, reach, shard))
    of = classes.join(root, classes.fp == root.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return signed.join(of, "fp")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lower-case hex digits), component_id, h (text hash).

    ``component_id`` is the smallest document id reachable by links of at most ``reach`` differing bits, the
    document's own included; texts without words share fingerprint 0.  Rows with a null id take part and get
    their component's smallest id (null if it has none).  No documents give no rows.
    """
    of = rooted(docs, **options)
    least = of.groupBy("root").agg(F.min("d").alias("component_id"))
    return of.join(least, "root").select(F.col("d").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "h")


def first_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text) for each root of ``rooted`` (d, h, root), with all columns.

    It is the row of the smallest (id, text hash); a null id comes after all others.  Of rows that repeat both, one
    is kept.
    """
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("void"), "d", "h")).alias("r"))
    chosen = least.select(F.xxhash64(F.col("r.void"), F.col("r.d"), F.col("r.h")).alias("_row")).distinct()
    row = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.xxhash64("text"))
    return docs.withColumn("_row", row).join(chosen, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row of the smallest id of each component, with all columns of ``docs``; one row of repeats.

    A component that has only null ids keeps one row too, that of the smallest text hash.
    """
    return first_of_each(docs, rooted(docs, **options))
