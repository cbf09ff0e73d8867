import random

import numpy as np
from xxhash import xxh64_intdigest

from siftline.llm.simhash import Tree, components, keep_one, near_duplicates, shard_links

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, reach=3):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)] + ["É", "it's"]
    docs = [(None, "no id"), (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "one two")]
    for i in range(10, 120):
        docs.append((i, " ".join(rng.choices(vocab, k=rng.choice([3, 30, 400])))))
    for i in range(120, 220):
        words = docs[rng.randrange(7, 100)][1].split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    docs += [docs[20], (20, "another text"), (500, "long " * 30_000)]
    return docs


def test_matches_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as d", "3 as root")
    fps = [fingerprint(t) for _, t in docs]
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, classes([d for d, _ in docs], fps))), key=repr)
    for shard in (8192, 8):
        got = sorted((tuple(r) for r in near_duplicates(frame, shard=shard).drop("h").collect()), key=repr)
        assert got == want
    kept = [r.doc_id for r in keep_one(frame).collect()]
    first = {}  # an id that stands on texts of two components is kept for each
    for (d, _), root in zip(docs, classes(range(len(docs)), fps)):
        first[root] = min((x for x in (d, first.get(root)) if x is not None), default=None)
    assert sorted(x for x in kept if x is not None) == sorted(x for x in first.values() if x is not None)


def near_points(n=6000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    for _ in range(4):
        i, j = rng.integers(0, n, (2, n // 4))
        x[i] = x[j] ^ (np.uint64(1) << rng.integers(0, 64, n // 4, dtype=np.uint64))
    return np.unique(x)


def test_trees_lose_no_link():
    x = near_points()
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    i, j = np.nonzero((d <= 3) & (np.arange(len(x))[:, None] < np.arange(len(x))))
    up = list(range(len(x)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in zip(i, j):
        up[root(a)] = root(b)
    want = {root(k) for k in range(len(x))}
    tree, place = Tree(x[:2000], 16), {int(v): k for k, v in enumerate(x)}
    homes, edges = 0, []
    for _, rows, home in tree.route(x, 3):
        homes += home.sum()
        a, b = shard_links(x[rows], home, 3)
        edges += list(zip(a, b))
    assert homes == len(x) and tree.leaves > 8
    up[:] = range(len(x))
    for a, b in edges:
        up[root(place[int(a)])] = root(place[int(b)])
    assert len({root(k) for k in range(len(x))}) == len(want)
    for a, b in zip(i, j):
        assert root(a) == root(b)


def test_long_chains(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (200, 200)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(500)], k=60))
    a, b, c, d, e = (text() for _ in range(5))
    docs = [(None, a), (None, b), (None, c), (None, c), (1, d), (1, e), (1, e), (2, d), (3, e), (None, d)]
    kept = keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(None, a), (None, b), (None, c), (1, d), (1, e)]))
