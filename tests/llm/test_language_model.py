import collections
import math
import random
import re
import zlib

import numpy as np

from siftline.llm import language_model as lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]


class Brute:
    def __init__(self, texts):
        self.c, self.pair, self.start = collections.Counter(), collections.Counter(), len(texts)
        for t in texts:
            w = toks(t) + ["</s>"]
            self.c.update(w)
            self.pair.update(zip(["<s>", *w], w))
        self.N, self.V = sum(self.c.values()), len(self.c)
        self.left = collections.Counter(w for _, w in self.pair)
        self.follow = collections.defaultdict(lambda: [0, 0, 0])
        for (v, _), n in self.pair.items():
            self.follow[v][min(n, 3) - 1] += 1
        of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.D, self.E = lm.discounts(of(self.pair)), lm.discounts(of(self.left))
        self.A = len(self.pair)

    def single(self, w):
        spare = sum(self.E[min(n, 3) - 1] for n in self.left.values())
        a = self.left[w]
        return ((a - self.E[min(a, 3) - 1] if a else 0) + spare / (self.V + 1)) / self.A

    def p(self, v, w):
        total = self.start if v == "<s>" else self.c[v]
        if not total:
            return self.single(w)
        n = self.pair[v, w]
        rest = sum(d * k for d, k in zip(self.D, self.follow[v]))
        return ((n - self.D[min(n, 3) - 1] if n else 0) + rest * self.single(w)) / total

    def score(self, text):
        w = toks(text) + ["</s>"]
        return sum(math.log10(self.p(v, x)) for v, x in zip(["<s>", *w], w))

    def base(self, text):
        return sum(math.log10((self.c[w] + 0.1) / (self.N + 0.1 * (self.V + 1))) for w in toks(text) + ["</s>"])


def corpus(n=160):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)] + ["É", "The", "the"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(63)], k=rng.choice([0, 1, 5, 60])))) for i in range(n)]
    return rows + [(None, "w1 w2"), (n, None), rows[3], (n + 1, "unseen words w1 unseen"), (n + 2, "w5 " * 20_000)]


def check(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d", "2 as held_out", "3 as h").repartition(parts)
    out = [False if d is None else zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows]
    model = Brute([t for (_, t), train in zip(rows, out) if train])
    want = sorted(((d, not train, len(toks(t)) + 1, sum(model.c[w] > 0 for w in toks(t) + ["</s>"]), model.N, model.base(t), model.score(t)) for (d, t), train in zip(rows, out)), key=lambda r: (str(r[0]), r[2]))
    got = sorted((tuple(r) for r in lm.score(frame).collect()), key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert np.allclose(g[5:], w[5:], rtol=1e-9, atol=1e-9), (g, w)
    return model, want


def test_matches_brute_force(spark, monkeypatch):
    model, want = check(spark, corpus())
    words = list(model.c) + ["unknown"]
    for v in ("<s>", "w0", "unknown"):
        assert abs(sum(model.p(v, w) for w in words) - 1) < 1e-9
    monkeypatch.setattr(lm, "SHARD", 200)
    monkeypatch.setattr(lm, "SPREAD", 50)
    monkeypatch.setattr(lm, "GATHER", 300)
    check(spark, corpus(), parts=20)


def test_held_out_text_scores_above_base(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        w = ["w0"]
        for _ in range(50):
            w.append(f"w{(int(w[-1][1:]) * 3 + rng.randrange(3)) % 97}")
        rows.append((i, " ".join(w)))
    held = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert held and all(r.score > r.base_score + 20 for r in held)


def test_nothing_to_train_on(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = lm.score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3] and all(r.train_tokens == 0 and r.score == 0 == r.base_score for r in rows)
