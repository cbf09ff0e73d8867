"""Pairs of sets that may be similar, by bitmaps alone: blocks of sets of neighbouring sizes meet in cells.

Two sets of n and m members with a Jaccard similarity of t or more differ in at most (n + m) (1 - t) / (1 + t) members, and
their parity bitmaps in no more bits.  Where bitmaps grow with the sets, hardly any other pair passes, so all pairs whose sizes
allow it are tested and no pair is lost.  A bitmap folds to a narrower one, which is tested first.

A set goes once to each cell of its block: the row of a cell is a size and a bitmap, never the members, and a block takes a
sixteenth of the sets or so, up to a fixed number of bytes.  So what moves grows with the number of sets; the tests, a few
nanoseconds each, grow with its square.

Sets of different languages, say, are not tested: members are dealt to disjoint sides, and a set leans to a side if its members
there outnumber those of any other side by more than (1 - t) / (1 + t) of all its members.  A pair that leans to different
sides then differs in more members than the bound allows, whatever the sides are; they are learned from some sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks that all sets are dealt to, about; least sets of a block; bytes of a block's bitmaps at most.
BLOCKS, LEAST, BYTES = 16, 1024, 16 << 20
#: 64-bit words of a bitmap at most; sets that one test takes at once; pairs of one batch that is handed on.
WIDEST, TILE, BATCH = 256, 8192, 100_000
#: Pairs whose whole bitmaps are compared at once.
MET = 4096
#: Sets that sides are learned from, about; numbers that members are hashed to for it, and those of them that are looked at.
LEARNED, HASHED, SEEN = 1024, 1 << 16, 4096
#: Groups that the learning begins with; difference of two groups' rates that puts a number on a side.
GROUPS, APART = 12, 0.02
#: Bits of the first test for each member in which two sets may differ.
FIRST = 3.2
#: Allowance for rounding in bounds: a bound is only ever taken too wide.
EPS = 1e-9


def parity(g: np.ndarray, words: int = 16) -> np.ndarray:
    """A bit is one if an odd number of members falls on it: two sets' bitmaps differ in as many bits as members at most."""
    x = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    odd = np.bincount(((x >> np.uint64(32)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def words_for(n: int) -> int:
    """Words of the bitmap of n members: a bit a member at least; two and four for large sets, which come closer to one another."""
    bits = n * (1 if n <= 512 else 2 if n <= 1024 else 4)
    return min(WIDEST, 1 << max(0, math.ceil(math.log2(max(bits / 64, 1)))))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) as those of fewer words."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1) if bits.shape[1] > words else bits


def grouped(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) as those of any fewer words."""
    if bits.shape[1] <= words:
        return bits
    parts = -(-bits.shape[1] // words)
    wide = np.zeros((len(bits), parts * words), bits.dtype)
    wide[:, : bits.shape[1]] = bits
    return np.bitwise_xor.reduce(wide.reshape(len(bits), parts, words), axis=1)


def bitmaps(sets: DataFrame, t: float | None = None) -> DataFrame:
    """i, n, bits of every set (i, grams; with ``t`` a written table) that has an id and members; with ``t`` also lean, its side or 0."""
    known = sets.where(F.col("i").isNotNull() & (F.size("grams") > 0))
    side = None if t is None else learned_sides(known, t)
    share = 1.0 if t is None else (1 - t) / (1 + t)

    @F.arrow_udf("struct<bits:array<bigint>,lean:int>")
    def run(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
        maps = [parity(flat[y - n : y], words_for(int(n))) for y, n in zip(ends, sizes)]
        bits = pa.ListArray.from_arrays(np.cumsum([0, *map(len, maps)], dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *maps]))
        lean = [0 if side is None else leaning(flat[y - n : y], side, share) for y, n in zip(ends, sizes)]
        return pa.StructArray.from_arrays([bits, pa.array(lean, pa.int32())], ["bits", "lean"])

    made = known.select("i", F.size("grams").alias("n"), run(F.col("grams")).alias("made"))
    return made.select("i", "n", "made.bits", *(["made.lean"] if t is not None else []))


def hashed(g: np.ndarray) -> np.ndarray:
    return ((g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % HASHED


def leaning(g: np.ndarray, side: np.ndarray, share: float) -> int:
    """The side that a set leans to, or 0."""
    counts = np.bincount(side[hashed(g)], minlength=3)[1:]
    second, first = np.partition(counts, -2)[-2:]
    return int(np.argmax(counts)) + 1 if first - second > share * len(g) + EPS else 0


def learned_sides(sets: DataFrame, t: float) -> np.ndarray | None:
    """The side (1, 2, ...) of every number that a member is hashed to, 0 for none; None if sides would save little.

    Sides only tell which pairs need no test; which sets they are learned from changes no result.
    """

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        seen = np.zeros((len(lists), HASHED), bool)
        for k, g in enumerate(lists):
            seen[k, hashed(g.values.to_numpy())] = True
        return pa.array([x.tobytes() for x in np.packbits(seen, axis=1)], pa.binary())

    step = max(1, sets.count() // LEARNED)
    some = sets.where(F.pmod(F.xxhash64("i"), F.lit(step)) == 0).limit(2 * LEARNED).select(run(F.col("grams")).alias("seen")).collect()
    if len(some) < 64:
        return None
    return sides(np.unpackbits(np.array([np.frombuffer(r.seen, np.uint8) for r in some]), axis=1), (1 - t) / (1 + t))


def sides(seen: np.ndarray, share: float) -> np.ndarray | None:
    """Sides from sets (rows) of numbers: groups of similar sets, of which those that leave many sets without a side are joined."""
    rates = seen.mean(axis=0)
    looked = np.argsort(-rates * (1 - rates), kind="stable")[:SEEN]
    x, n = seen[:, looked].astype(np.float32), np.maximum(seen.sum(axis=1), 1)
    group = likest(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))
    least, best = 0.9, None
    while len(names := [g for g in np.unique(group) if g >= 0]) > 1:
        mean = np.array([x[group == g].mean(axis=0) for g in names])
        second, first = np.partition(mean, -2, axis=0)[-2:]
        on = np.where(first - second > APART, np.argmax(mean, axis=0), -1)
        counts = x @ (on[:, None] == np.arange(len(names))).astype(np.float32)
        order = np.argsort(-counts, axis=1, kind="stable")[:, :2]
        lead = np.take_along_axis(counts, order, axis=1)
        open_ = lead[:, 0] - lead[:, 1] <= share * n
        cost = ((np.bincount(order[~open_, 0], minlength=1) / len(x)) ** 2).sum() + 1 - (1 - open_.mean()) ** 2
        if cost < least:
            least, best = cost, np.zeros(HASHED, np.int64)
            best[looked] = on + 1
        if not open_.any():
            break
        pairs, often = np.unique(np.sort(order[open_], axis=1), axis=0, return_counts=True)
        one, two = pairs[np.argmax(often)]
        group[group == names[two]] = names[one]
    return best


def likest(unit: np.ndarray) -> np.ndarray:
    """Groups of rows of length 1 by k-means; -1 for rows of groups with less than a hundredth of them."""
    rng = np.random.default_rng(1)
    centers = unit[rng.choice(len(unit), 1)]
    for _ in range(GROUPS - 1):
        far = np.maximum(1 - (unit @ centers.T).max(axis=1), 0).astype(float) + 1e-12
        centers = np.vstack([centers, unit[rng.choice(len(unit), p=far / far.sum())]])
    for _ in range(8):
        group = np.argmax(unit @ centers.T, axis=1)
        sums = np.array([unit[group == g].sum(axis=0) for g in range(GROUPS)])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return np.where(np.bincount(group, minlength=GROUPS)[group] * 100 >= len(unit), group, -1)


def dealt(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """least size, greatest size, slots of blocks, from (size, sets of it) in order; bitmaps of a block are equally wide.

    A size with more sets than a block takes is a block of several slots.
    """
    out, held, target = [], 0, max(LEAST, sum(c for _, c in sizes) // BLOCKS)
    for n, c in sizes:
        most = max(1, min(target, BYTES // (8 * words_for(n))))
        if out and out[-1][2] == 1 and held + c <= most and words_for(out[-1][0]) == words_for(n):
            out[-1] = (out[-1][0], n, 1)
            held += c
        else:
            out.append((n, n, -(-c // most)))
            held = c
    return out


def cells(blocks: list[tuple[int, int, int]], t: float, leans: list[int] | None = None) -> list[tuple[int, int, int]]:
    """block, cell, side: every two blocks whose sizes allow pairs meet in a cell, one of them as side 0; alone it is side 2.

    Blocks of different ``leans`` (in order) meet only if one of them is 0.
    """
    each = [(lo, hi, lean) for (lo, hi, slots), lean in zip(blocks, leans or [0] * len(blocks)) for _ in range(slots)]
    out, cell = [], 0
    for y, (lo, hi, lean) in enumerate(each):
        for x in range(y, -1, -1):
            if each[x][2] not in (0, lean) or each[x][1] < t * lo - EPS or hi < t * each[x][0] - EPS:
                continue
            out += [(y, cell, 2)] if x == y else [(x, cell, 0), (y, cell, 1)]
            cell += 1
    return out


def candidates(rows: DataFrame, t: float, cap: int | None = None) -> DataFrame:
    """a, b, score: all pairs of ``rows`` (i, n, bits, c, and lean for the same ``t`` if known; a written table) of different c that may reach ``t``, each once.

    ``score`` is the share of bits that differ, by the sizes.  With ``cap`` a set has no more candidates than that in a
    cell, those of least score; every set of a pair left out is a row with b null.
    """
    spark, sizes = rows.sparkSession, {}
    rows = rows if "lean" in rows.columns else rows.withColumn("lean", F.lit(0))
    for r in rows.groupBy("lean", "n").agg(F.count("*").alias("k")).orderBy("lean", "n").collect():  # a row for each side and size
        sizes.setdefault(r.lean, []).append((r.n, r.k))
    leans, blocks = zip(*[(lean, b) for lean in sizes for b in dealt(sizes[lean])]) if sizes else ((), ())
    plan = cells(blocks, t, leans)
    if not plan:
        return spark.createDataFrame([], "a long, b long, score double")
    least, slots = np.array([(lean << 32) + b[0] for lean, b in zip(leans, blocks)]), np.array([b[2] for b in blocks])
    first = np.cumsum(slots) - slots

    @F.arrow_udf("int")
    def block(key: pa.Array, salt: pa.Array) -> pa.Array:
        k = np.searchsorted(least, key.to_numpy(), "right") - 1
        return pa.array(first[k] + salt.to_numpy() % slots[k], pa.int32())

    key = F.shiftleft(F.col("lean").cast("long"), 32) + F.col("n")
    placed = rows.withColumn("block", block(key, F.xxhash64("i").bitwiseAND(F.lit((1 << 31) - 1))))
    plan_rows = F.broadcast(spark.createDataFrame(plan, "block int, cell int, side int"))  # some thousands
    sent = placed.join(plan_rows, "block").select("cell", "side", "i", "c", "n", "bits")
    many = max(cell for _, cell, _ in plan) + 1
    at_home = sent.repartitionById(many, F.col("cell")).sortWithinPartitions("cell", "side", "n")
    return at_home.mapInArrow(lambda batches: meet(batches, t, cap), "a long, b long, score double")


def meet(batches: Iterator[pa.RecordBatch], t: float, cap: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of cells in order, a block's first: each row of the other is tested with all of the block."""
    now, block = None, Block(t, cap)
    for batch in batches:
        cell, side, i, c, n = (batch.column(k).to_numpy() for k in range(5))
        lists = batch.column(5)
        change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
        for x, y in zip([0, *change], [*change, len(cell)]):
            if x == y:
                continue
            if now != cell[x]:
                yield from block.end()
                now, block = cell[x], Block(t, cap)
            bits = lists.slice(x, y - x).flatten().to_numpy().reshape(y - x, -1).view(np.uint64)
            part = (i[x:y], c[x:y], n[x:y].astype(np.int64), bits)
            if side[x] == 1:
                yield from block.test(*part)
            else:
                block.add(*part, alone=side[x] == 2)
    yield from block.end()


class Block:
    """The sets of one side of a cell, in order of size."""

    def __init__(self, t: float, cap: int | None) -> None:
        self.t, self.cap, self.parts, self.width, self.alone = t, cap, [], 0, False
        self.share = (1 - t) / (1 + t)

    def add(self, *part: np.ndarray, alone: bool) -> None:
        self.parts.append(part)
        self.alone = alone

    def ready(self, words: int) -> None:
        """Bitmaps as wide as the other side's, and the folded ones word by word."""
        self.i, self.c, self.n, bits = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        self.parts, self.width = [], min(words, bits.shape[1])
        self.bits = folded(bits, self.width)
        self.few = min(self.width, max(1, math.ceil(self.n[-1] * self.share * 2 * FIRST / 64)))
        self.planes = np.ascontiguousarray(grouped(self.bits, self.few).T)
        self.held = np.empty((self.few, TILE), np.uint64), np.empty((self.few, TILE), np.uint8)
        self.may = (np.minimum(self.n * self.share, 64 * WIDEST) + 1).astype(np.uint16)
        self.over = np.zeros(len(self.i), bool)

    def test(self, i: np.ndarray, c: np.ndarray, n: np.ndarray, bits: np.ndarray, own: int | None = None) -> Iterator[pa.RecordBatch]:
        """Each row with the block's sets; with ``own``, the row's place in the block, with those before it."""
        if not self.width:
            if not self.parts:
                return
            self.ready(bits.shape[1])
        bits = folded(bits, self.width)
        few = grouped(bits, self.few)[:, :, None]
        low = np.searchsorted(self.n, np.ceil(self.t * n - EPS))
        high = np.searchsorted(self.n, np.floor(n / self.t + EPS), "right") if own is None else own + np.arange(len(n))
        met, held = [], 0
        for k in range(len(i)):
            hit = self.near(few[k], int(n[k]), int(low[k]), int(high[k]))
            if len(hit):
                met.append((k, hit))
                held += len(hit)
            if held > MET:
                yield from self.whole(i, c, n, bits, met)
                met, held = [], 0
        yield from self.whole(i, c, n, bits, met)

    def whole(self, i: np.ndarray, c: np.ndarray, n: np.ndarray, bits: np.ndarray, met: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """What is handed on of rows and the places that passed their first test, by the whole bitmaps; many rows at once."""
        if not met:
            return
        row, hit = np.repeat([k for k, _ in met], [len(h) for _, h in met]), np.concatenate([h for _, h in met])
        other = self.c[hit] != c[row]
        row, hit = row[other], hit[other]
        out = []
        for x in range(0, len(row), MET):
            k, h = row[x : x + MET], hit[x : x + MET]
            both = self.n[h] + n[k]
            differ = np.bitwise_count(self.bits[h] ^ bits[k]).sum(axis=1, dtype=np.int64)
            fits = differ <= both - 2 * np.ceil(both * (self.t / (1 + self.t)) - EPS)
            out.append((k[fits], h[fits], (differ / both)[fits]))
        row, hit, score = (np.concatenate([f[k] for f in [(row[:0], hit[:0], np.zeros(0)), *out]]) for k in range(3))
        left = []
        if self.cap is not None and len(row):
            best = np.lexsort((self.i[hit], score, row))
            row, hit, score = row[best], hit[best], score[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            over = place >= self.cap
            self.over[hit[over]] = True
            left = [(i[np.unique(row[over])], None, None)] if over.any() else []
            row, hit, score = row[~over], hit[~over], score[~over]
        for x in range(0, len(row), BATCH):
            left.append((i[row[x : x + BATCH]], self.i[hit[x : x + BATCH]], score[x : x + BATCH]))
            yield from handed_on(left)
            left = []
        yield from handed_on(left)

    def near(self, row: np.ndarray, n: int, low: int, high: int) -> np.ndarray:
        """Places in the block, from ``low`` to ``high``, whose folded bitmap differs in few enough bits."""
        found, extra = [], np.uint16(min(int(n * self.share), 64 * WIDEST) + 1)
        for x in range(low, high, TILE):
            y = min(x + TILE, high)
            bits, counts = self.held[0][:, : y - x], self.held[1][:, : y - x]
            np.bitwise_count(np.bitwise_xor(self.planes[:, x:y], row, out=bits), out=counts)
            differ = np.add.reduce(counts, axis=0, dtype=np.uint16)
            found.append(np.flatnonzero(differ <= self.may[x:y] + extra) + x)
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.int64), *found])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.alone:
            self.ready(WIDEST)
            for x in range(0, len(self.i), TILE):
                y = slice(x, x + TILE)
                yield from self.test(self.i[y], self.c[y], self.n[y], self.bits[y], own=x)
        if self.width and self.over.any():
            yield from handed_on([(self.i[self.over], None, None)])


def handed_on(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Pairs and, with b null, sets of pairs left out."""
    pairs, alone = [f for f in found if f[1] is not None], [f[0] for f in found if f[1] is None]
    names = ["a", "b", "score"]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in pairs])) for k in range(3)], names)
    if alone:
        ids = np.concatenate(alone)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.float64())], names)
