import collections
import random

from siftline.llm.mixing import Mix, mix_sizes, mix_texts, permuted
from pyspark.sql import functions as F


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if unit * w[s] > most * sizes[s]}
        if not over:
            target |= {s: unit * w[s] for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as size", "2 as rank", "3 as block")


def corpus(n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", "é", "Z", None])
        size = rng.choice([0, 1, 5, 40, 300])
        rows.append((i, " ".join(f"t{i}_{k}" for k in range(size)), "en", source, 0))
    return rows + [rows[5], (5, None, "en", "a", 0), (None, "one two\tthree", None, "b", 0), (9000, "tiny", "en", "tiny", 4), (9001, "word " * 30_000, "en", "c", 0)]


def test_targets_and_taken(spark):
    rows = corpus()
    out = mix_sizes(make(spark, rows), block=16, shard_slots=500).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = fill(dict(sizes))
    assert len(out) == len(rows)
    assert sorted((repr(r.doc_id), r.size) for r in out) == sorted((repr(r[0]), len((r[1] or "").split())) for r in rows)
    names = sorted((s for s in sizes if s is not None)) + [None]
    taken = collections.Counter()
    for r in out:
        s = names[r.source_rank]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 4 * 16, (s, taken[s], want[s])
    again = mix_sizes(make(spark, rows).repartition(7), block=16, shard_slots=500).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_slots(spark):
    mix = Mix(make(spark, corpus()), block=16, shard_slots=500)
    quota = {r.rank: (r.quota, r.blocks) for r in mix.sources.collect()}
    slots = mix.slots.collect()
    assert sorted(r.slot for r in slots) == list(range(sum(q for q, _ in quota.values())))
    for rank, (q, blocks) in quota.items():
        mine = [r for r in slots if r.rank == rank]
        assert sorted(r.k for r in mine) == list(range(q))
        for e in {r.epoch for r in mine}:
            got = [r.block for r in mine if r.epoch == e]
            assert len(set(got)) == len(got) and all(0 <= b < blocks for b in got)


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 7, 100, 1000):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def test_texts(spark):
    rows = corpus()
    out = mix_texts(make(spark, rows), block=16, shard_slots=500)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = collections.Counter()
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r[0]].update((r[1] or "").split())
    for r in out.collect():
        assert set(r.text.split()) <= by_id[r.doc_id] and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    want = collections.Counter()
    for r in mix_sizes(make(spark, rows), block=16, shard_slots=500).collect():
        want[r.doc_id] += r.taken
    assert words == +want


def test_empty(spark):
    assert mix_sizes(make(spark, [])).collect() == []
    assert [r.taken for r in mix_sizes(make(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)])).collect()] == [0, 0]


def test_small_sources_meet_their_targets(spark):
    rng = random.Random(6)
    for sizes in ({"a": [100], "b": [100]}, {"a": [300], "b": [1], None: [100, 7]}, {"a": [1], "b": [1], "c": [1], "d": [90, 300, 4000]}, {"x": [129, 1, 0], "y": [5] * 60}):
        rows = [(rng.randrange(1 << 40), " ".join(["w"] * n), "en", s, 0) for s, ns in sizes.items() for n in ns]
        want = fill({s: sum(ns) for s, ns in sizes.items()})
        names, taken = sorted(s for s in sizes if s is not None) + [None] * (None in sizes), collections.Counter()
        for r in mix_sizes(make(spark, rows)).collect():
            taken[names[r.source_rank]] += r.taken
            assert r.taken <= 3 * r.size
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 0.5 + 1e-9, (sizes, s, taken[s], want[s])


def test_very_long_text_and_rows_that_differ_only_in_source(spark):
    long = " ".join(str(i) for i in range(400_000))
    rows = [(1, long, "en", "a", 0), (2, "x y z", "en", "b", 0), (2, "x y z", "en", "c", 0)]
    out = mix_texts(make(spark, rows)).collect()
    want = {s: 0 for s in "abc"}
    for r in out:
        want[r.source] += len(r.text.split())
        numbers = [int(x) for x in r.text.split()] if r.source == "a" else []
        assert numbers == sorted(set(numbers))
    assert want["b"] == want["c"] == 9 and abs(want["a"] - (400_006 - 18)) <= 1
