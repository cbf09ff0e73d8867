import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import blocks, setjoin
from siftline.scratch import stored


def families(seed, n=120, universe=300):
    """Sets of all sizes: strangers, families of near copies, subsets, and some that just reach or miss a threshold."""
    rng, out = random.Random(seed), [set(), {1}, {1}, {1, 2}]
    while len(out) < n:
        base = {min(int(rng.paretovariate(0.6)), universe) + rng.randrange(universe // 3) for _ in range(rng.choice([2, 5, 9, 10, 40, 150]))}
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = set(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 6)):
                copy.discard(rng.choice(sorted(copy) or [0]))
                if rng.random() < 0.5:
                    copy.add(rng.randrange(2 * universe))
            out.append(copy)
    return out[:n]


def table(spark, sets, first=0):
    rows = [(i + first, sorted(s), [int(x) for x in setjoin.parity(np.array(sorted(s), np.int64))]) for i, s in enumerate(sets)]
    return stored(spark.createDataFrame(rows, "i long, grams array<long>, bits array<long>"))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("t", [0.8, 0.78, 0.5, 0.3])
def test_pairs_match_brute_force(spark, t):
    sets = families(int(100 * t))
    got = {(r.i, r.j): r.jaccard for r in setjoin.similar_pairs(table(spark, sets), t).collect()}
    want = {(i, j): jaccard(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and jaccard(a, b) >= t}
    assert got == pytest.approx(want) and len(want) > 20


def test_both_sides_match_brute_force(spark):
    one, two = families(7, 60), families(8, 90)
    two[10:20] = [set(s) for s in one[10:20]]
    got = {(r.i, r.j) for r in setjoin.similar_across(table(spark, one), table(spark, two, 1000), 0.6).collect()}
    assert got == {(i, 1000 + j) for i, a in enumerate(one) for j, b in enumerate(two) if a and b and jaccard(a, b) >= 0.6}


def roots(sets, t):
    of = list(range(len(sets)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and jaccard(a, sets[j]) >= t:
                x, y = sorted((top(i), top(j)))
                of[y] = x
    return {i: top(i) for i in range(len(sets)) if top(i) != i}


@pytest.mark.parametrize("hot, hubs, fat", [(2000, 4, 16), (3, 1, 2)])
def test_components_match_brute_force(spark, monkeypatch, hot, hubs, fat):
    for name, value in (("HOT", hot), ("HUBS", hubs), ("FAT", fat)):
        monkeypatch.setattr(setjoin, name, value)
    sets = families(hot, 150)
    got = {r.node: r.root for r in setjoin.similar_components(table(spark, sets), 0.8).collect()}
    assert got == roots(sets, 0.8)


def test_a_chain_that_hubs_do_not_close(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HUBS", 1)
    monkeypatch.setattr(setjoin, "FAT", 1)
    sets = [set(range(i, i + 40)) for i in range(0, 80, 4)]  # neighbours alone are similar
    got = {r.node: r.root for r in setjoin.similar_components(table(spark, sets), 0.8).collect()}
    assert got == {i: 0 for i in range(1, len(sets))}


def test_a_large_group_does_not_make_all_pairs(spark):
    rng, base = random.Random(2), list(range(60))
    sets = [set(base) | {1000 + rng.randrange(5000)} for _ in range(600)] + families(3, 40)
    held = table(spark, sets)
    posts = stored(setjoin.prefixes(held, 0.8))
    assert {r.root for r in setjoin.similar_components(held, 0.8).collect() if r.node < 600} == {0}
    pairs = setjoin.met_once(posts, 0.8).select("x.i", "y.i").distinct().count()
    assert pairs > 100_000  # what the hubs save


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 3000):
        a = np.unique(rng.integers(0, 1 << 62, n))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 62, n // 3)]))
        differ = int(np.bitwise_count((setjoin.parity(a) ^ setjoin.parity(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


@pytest.mark.parametrize("t, cap", [(0.8, None), (0.5, None), (0.8, 1)])
def test_blocks_test_all_pairs_and_move_no_members(spark, monkeypatch, t, cap):
    """Before, most texts of one language met by a shared shingle, each time with a bitmap: disk grew faster than the input."""
    for name, value in (("LEAST", 7), ("BLOCKS", 3), ("TILE", 4), ("BATCH", 5)):
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(4)
    large = [set(rng.sample(range(1500), 1100)) for _ in range(4)]
    sets = families(5, 160) + large + [s - {rng.choice(sorted(s))} for s in large]
    maps = stored(blocks.bitmaps(table(spark, sets)).withColumn("c", F.col("i") % 140))
    met = blocks.candidates(maps, t, cap)
    rows = [tuple(r) for r in met.collect()]
    pairs = [tuple(sorted(r[:2])) for r in rows if r[1] is not None]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and i % 140 != j % 140 and jaccard(a, b) >= t}
    left = {r[0] for r in rows if r[1] is None}
    assert len(pairs) == len(set(pairs)) and len(want) > 20
    assert want - set(pairs) == set() if cap is None else all({i, j} <= left for i, j in want - set(pairs))
    assert bool(left) == (cap is not None) and "explode" not in met._jdf.queryExecution().executedPlan().toString().lower()


def test_sizes_that_many_sets_have_are_dealt_over_slots():
    sizes = [(1, 5), (2, 5000), (3, 10), (1024, 3000), (1025, 3000), (20000, 9000)]
    found = blocks.dealt(sizes)
    assert [(lo, hi) for lo, hi, _ in found] == [(n, n) for n, _ in sizes] and [b[2] for b in found] == [1, 4, 1, 3, 3, 8]
    each = [(lo, hi) for lo, hi, slots in found for _ in range(slots)]
    met = {}
    for block, cell, side in blocks.cells(found, 0.8):
        met.setdefault(cell, []).append(block)
    assert sorted(tuple(sorted(b)) for b in met.values()) == sorted((x,) if x == y else (x, y) for y in range(len(each)) for x in range(y + 1) if each[x][1] >= 0.8 * each[y][0])


def test_packed_sets_are_read_back_and_compared(spark):
    sets = [set(), {0}, {5, 1 << 62, (1 << 63) - 1}, {5, 1 << 62}]
    held = table(spark, sets)
    rows = held.select("i", setjoin.packed(F.col("grams")).alias("p")).collect()
    assert {r.i: set(setjoin.unpacked(r.p).tolist()) for r in rows} == dict(enumerate(sets))
    pairs = spark.createDataFrame([(0, 0), (2, 3), (1, 3)], "i long, j long")
    assert {(r.i, r.j): r.jaccard for r in setjoin.compared(pairs, held, held).collect()} == {(0, 0): 1.0, (2, 3): 2 / 3, (1, 3): 0.0}


def test_sets_that_lean_to_different_sides_are_not_tested(spark, monkeypatch):
    """Before, texts of different languages were tested with each other wherever their sizes allowed it."""
    rng = random.Random(6)
    sets = [set(rng.sample(range(1000 * (k % 3), 1000 * (k % 3) + 120), rng.randrange(75, 90))) for k in range(240)]
    sets += [set(list(a)[:40]) | set(list(b)[:40]) for a, b in zip(sets[:30], sets[1:31])]
    sets += [s - {min(s)} for s in sets[:60] + sets[-20:]]
    held = stored(table(spark, sets))
    maps = stored(blocks.bitmaps(held, 0.8).withColumn("c", F.col("i")))
    lean = {r.i: r.lean for r in maps.collect()}
    sides = [{lean[i] for i in range(k, 240, 3)} - {0} for k in range(3)]
    assert sum(lean[i] > 0 for i in range(240)) > 200 and len(set.union(*sides)) == sum(map(len, sides)) >= 3
    want = {(i, j) for i, a in enumerate(sets) for j in range(i) for b in [sets[j]] if jaccard(a, b) >= 0.8}
    got = {(max(r.a, r.b), min(r.a, r.b)) for r in blocks.candidates(maps, 0.8).collect()}
    assert want <= got and len(want) >= 60
    end = [(1, 9, 1), (8, 9, 2)]
    assert len(blocks.cells(end * 2, 0.8, [1, 1, 2, 2])) < len(blocks.cells(end * 2, 0.8)) == len(blocks.cells(end * 2, 0.8, [0, 0, 1, 1]))


def test_bitmaps_group_to_any_fewer_words():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 62, 900))
    b = a[60:]
    one, two = (blocks.parity(s, 32).view(np.uint64)[None] for s in (a, b))
    for words in (1, 3, 5, 6, 16, 40):
        assert int(np.bitwise_count(blocks.grouped(one, words) ^ blocks.grouped(two, words)).sum()) <= 60
        assert blocks.grouped(one, words).shape == (1, min(words, 32))
