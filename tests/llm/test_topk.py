import math

import numpy as np

from siftline.llm import topk


def brute(rows, k=5):
    clean = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in clean:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as dim").repartition(5)
    return sorted(tuple(r) for r in topk.top_k(frame, **options).collect())


def vectors(n=700, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    x = (centres[rng.integers(0, 9, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    x[200:260] = x[200]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [(None, rows[0][1]), (n, None), (n + 1, []), (n + 2, [None] * dim), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] * dim), (50 * n, [0.0] * dim), (50 * n + 1, [1.0, 2.0]), (50 * n + 50, [1.0, -2.0]), rows[7], (-50, rows[3][1])]


def test_matches_brute_force(spark, monkeypatch):
    assert run(spark, vectors()) == brute(vectors())
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "BATCH", 7)
    assert run(spark, vectors(), chunk_bytes=900) == brute(vectors())


def test_few_candidates_and_large_values(spark):
    rows = [(0, [1e5, -1e5]), (50, [3e5, 7.0]), (1, [-2e5, 1e4])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == [] == run(spark, [])


def test_bounds_leave_candidates_out(monkeypatch):
    rng = np.random.default_rng(1)
    v = np.round(256 * (rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] * 4 + 0.1 * rng.normal(size=(4000, 8)))).astype(np.int64)
    space = topk.Space(v[:500], int((v**2).sum(1).max()))
    seen, product = [], topk.product
    monkeypatch.setattr(topk, "product", lambda a, b: seen.append(len(a) * len(b)) or product(a, b))
    monkeypatch.setattr(topk, "BATCH", 64)
    best, q = topk.Best(10, 5), v[:10]
    topk.search_block(space, best, np.arange(10), q, np.arange(10), space.query(q), np.arange(4000), v, space.candidate(v))
    assert sum(seen) < 20_000
