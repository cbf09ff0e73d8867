import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import quality
from siftline.llm.quality import classify, fit, keep_good, kth_largest, log_weights


def corpus(n=1500):
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.choice([2, 5, 8]))) for _ in range(400)]
    insults, docs, labels, kinds = ["gruffalo", "snarkish", "zonkers"], [], [], {}
    for i in range(n):
        words = rng.choices(vocab, k=rng.choice([20, 80, 400]))
        kind = rng.choice(["good"] * 7 + ["toxic", "junk", "repeat"])
        if kind == "toxic":
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", "s", "ly"]))
        elif kind == "junk":
            words = [w + "%%%" for w in words]
            words = ["%%%" if rng.random() < 0.3 else w for w in words]
        elif kind == "repeat":
            words = [w for w in words[:20] for _ in range(9)]
        docs.append((i, " ".join(words)))
        kinds[i] = kind
        if rng.random() < 0.5:
            labels.append((i, int(kind not in ("junk", "repeat")), int(kind == "toxic")))
    return docs, labels, kinds


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "2 as good", "3 as log_weight")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text")


def test_held_out_accuracy(spark):
    docs, labels, kinds = corpus()
    extra = [(None, docs[0][1]), (9000, None), (9001, ""), (9002, " \n"), docs[1], (9003, docs[2][1] * 300)]
    d, lab = frames(spark, docs + extra, labels + [(None, 1, 0), (70, None, None), labels[0]])
    out = classify(d, lab).collect()
    assert len(out) == len(docs) + len(extra)
    unseen = [r for r in out if r.doc_id in kinds and r.doc_id not in {x[0] for x in labels}]
    rate = lambda k: sum(r.selected for r in unseen if kinds[r.doc_id] == k) / sum(kinds[r.doc_id] == k for r in unseen)
    assert rate("good") > 0.98 and rate("toxic") < 0.05 and rate("junk") < 0.05 and rate("repeat") < 0.05
    assert all(not r.selected and r.log_weight is None for r in out if r.doc_id in (9000, 9001, 9002))
    again = classify(d.repartition(5), lab).collect()
    assert sorted((repr(r.doc_id), r.gumbel_key or 0, r.selected) for r in again) == sorted((repr(r.doc_id), r.gumbel_key or 0, r.selected) for r in out)
    kept = keep_good(d, lab)
    assert kept.columns == d.columns
    assert kept.count() == sum(r.selected for r in out)


def test_top_k_is_by_key(spark):
    docs, labels, _ = corpus(400)
    out = classify(*frames(spark, docs, labels)).where("log_weight is not null").collect()
    least = min(r.gumbel_key for r in out if r.selected)
    assert all(r.selected == (r.gumbel_key >= least) for r in out)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), 3.0, -7.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values + [None]], "x double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert kth_largest(df, "x", k, bins=16, few=40) == ranked[k - 1]
    assert kth_largest(df, "x", 0) is None
    same = spark.range(5000).select(F.lit(1.5).alias("x"))
    assert kth_largest(same, "x", 4000, few=10) == 1.5
    assert kth_largest(df.where("false"), "x", 1) is None


def test_no_labels_and_no_documents(spark):
    docs, labels, _ = corpus(40)
    d, lab = frames(spark, docs, labels)
    assert classify(d.where("false"), lab).collect() == []
    assert all(r.selected for r in classify(d, lab.where("false")).collect())


def test_words_that_share_a_prefix_with_clean_ones(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(300)]
    clean, insults = [s + e for s in stems for e in ("", "er")], [stems[i] + "less" for i in range(5)]
    docs, labels, kinds = [], [], {}
    for i in range(1500):
        words = rng.choices(clean, k=rng.choice([40, 100]))
        kinds[i] = rng.random() < 0.8
        if not kinds[i]:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, 1, int(not kinds[i])))
    seen = {x[0] for x in labels}
    out = [r for r in classify(*frames(spark, docs, labels)).collect() if r.doc_id not in seen]
    rate = lambda k: sum(r.selected for r in out if kinds[r.doc_id] == k) / sum(kinds[r.doc_id] == k for r in out)
    print(rate(True), rate(False))
    assert rate(True) > 0.95 and rate(False) < 0.05


def test_models_and_weights_by_brute_force(spark):
    docs, labels, _ = corpus(300)
    docs += [(None, docs[0][1]), (9000, None), (9001, "one"), docs[3], (9002, docs[5][1] * 400)]
    d, lab = frames(spark, docs, labels)
    ratio, sample = fit(d.select("doc_id", "text"), lab)
    fits = {r.doc_id for r in sample.where("fits = 1").collect()}
    good = {i for i, q, t in labels if q == 1 and t == 0}
    assert fits < good and len(good) / 4 < len(fits) < 3 * len(good) / 4

    def grams(text):
        w = [x for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
        return w + list(zip(w, w[1:]))

    raw, target = collections.Counter(), collections.Counter()
    for i, t in docs:
        c = collections.Counter(grams(t))
        scale = min(1, 4000 / max(1, sum(n**0.7 for n in c.values())))
        for x, n in c.items():
            raw[x] += n**0.7 * scale
            target[x] += n**0.7 * scale * (i in fits)
    r, g = sum(raw.values()), sum(target.values())
    ratios = {}
    for x, n in raw.items():
        m, e = target[x], n * g / r
        p, q = (m + 1) / (g + quality.SIZE), (n + 1) / (r + quality.SIZE)
        ratios[x] = math.log(p / q) if abs(m - e) > 3 * math.sqrt(e + 1) else 0.0
    assert np.isclose(np.sort(ratio[ratio != 0]), np.sort([x for x in ratios.values() if x]), atol=1e-5).all()  # no bucket of these is shared
    want = {i: 1000 * sum(ratios[x] for x in grams(t)) / len(grams(t)) if grams(t) else None for i, t in docs}
    for row in log_weights(d, ratio).collect():
        assert row.log_weight == (pytest.approx(want[row.doc_id], abs=1e-2) if want[row.doc_id] is not None else None)


def test_keep_good_moves_no_text(spark):
    docs, labels, _ = corpus(300)
    d, lab = frames(spark, docs + [docs[0], (None, docs[1][1]), (9000, None)], labels)
    kept, out = keep_good(d, lab), classify(d, lab).where("selected")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect()) == sorted((repr(r.doc_id), r.text) for r in d.join(out.select(F.col("doc_id").alias("i"), F.col("h").alias("k")).distinct(), F.col("i").eqNullSafe(d.doc_id) & (F.col("k") == F.xxhash64("text")), "left_semi").collect())
