import hashlib
import random
import zlib

import numpy as np
import pytest

from siftline.llm import periodic


def brute(words, least=6, repeats=4):
    """All runs by their definition: every start, every period."""
    n, out = len(words), []
    for s in range(n):
        for q in range(1, n // repeats + 1):
            if s and s - 1 + q < n and words[s - 1] == words[s - 1 + q]:
                continue
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if length < max(least, repeats * q):
                continue
            run = words[s : s + length]
            if not any(all(run[i] == run[i + d] for i in range(length - d)) for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, repeats", [(6, 4), (2, 2), (9, 3)])
def test_runs_match_brute_force(least, repeats):
    rng = random.Random(least)
    for _ in range(400):
        n, kinds = rng.randrange(60), rng.choice([1, 2, 2, 3, 5])
        ids = [rng.randrange(kinds) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 8)
            ids[a:] = [ids[a + i % p] for i in range(n - a)]
        assert periodic.find_runs(np.array(ids, np.int64), least, repeats) == brute(ids, least, repeats)


def test_long_runs_and_multiples_of_periods():
    assert periodic.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    ids = np.tile(np.arange(1000), 6)
    assert periodic.find_runs(ids) == [(0, 6000, 1000)]


def expected(d, text):
    words = (text or "").encode().split()
    n = len(words)
    if d is not None and n:
        h = zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = (None,) * 4
    if runs:
        s, m, q = next(r for r in runs if all(r[1] * x[2] >= x[1] * r[2] for x in runs))
        best = (s, m, q, 1000 * m // q)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (d, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_report_on_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "b a a a a a a c", "x y x y x y x y x", "Ab ab Ab ab", "é é é é é é é"]
    texts += [" ".join(rng.choice(["on", "off", "é", "\x0bx", "u v"]) for _ in range(rng.randrange(200))) for _ in range(40)]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "z z z z z z z", "y", 1), (3, "a", "x", 3), (3, "a", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = sorted(map(tuple, periodic.report(periodic.periodic_runs(docs, rewrite=periodic.planted)).collect()), key=str)
    assert got == sorted((expected(d, t) for d, t, *_ in rows), key=str)


def test_very_long_text_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(60_000)) + " tail" * 12
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert row.n_words == 60_012 and [tuple(r) for r in row.runs] == [(60_000, 12, 1)]
    assert row.collapsed.endswith("w59999 tail")
    assert periodic.report(periodic.periodic_runs(docs.limit(0))).collect() == []
