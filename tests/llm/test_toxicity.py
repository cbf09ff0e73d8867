import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import toxicity
from siftline.llm.toxicity import FIXED, LabelModel, Lexicon, forms_of, word_counts


def corpus(n, seed=5, labelled=0.5):
    """Noise words in two languages; toxic ones hold insults, or made-up stems with many endings."""
    rng, docs, labels, truth = random.Random(seed), [], [], {}
    for i in range(n):
        words = [rng.choice("ab") + "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w = rng.choice(["grobelix", "snarfel"]) if i % 2 else rng.choice(["qrudel", "vorzen"]) + "".join(rng.choice("aeiou") for _ in range(4))
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        truth[i] = int(toxic)
        if rng.random() < labelled:
            labels.append((i, 1, int(toxic)))
    return docs, labels, truth


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_documents_are_told_apart(spark):
    docs, labels, truth = corpus(1500)
    rows = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 1500 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in rows)
    out = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out]
    caught, alarms = sum(p for t, p in out if t), sum(p for t, p in out if not t)
    assert caught >= 0.97 * sum(t for t, _ in out) and alarms <= 0.01 * len(out)


def test_labels_of_held_out_rows_have_no_say(spark):
    docs, labels, _ = corpus(400)
    table, kind = spark.createDataFrame(docs, "doc_id long, text string"), "doc_id long, quality int, toxic int"
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    one, two = (toxicity.score(table, spark.createDataFrame(x, kind)).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two


def test_odd_rows_and_tables(spark):
    docs, labels, _ = corpus(300)
    odd = [(None, "grobelix grobelix"), (None, None), (900, ""), (901, " \n"), (3, docs[3][1]), (902, "word " * 300_000 + "grobelix snarfel grobelix")]
    table = spark.createDataFrame([(*d, "y", 0.5, 1) for d in docs + odd], "doc_id long, text string, gold string, score double, f int")
    given = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (labels[0][0], 0, labels[0][2])], "doc_id long, quality int, toxic int")
    rows = toxicity.score(table, given).collect()
    assert len(rows) == 306 and all(r.score is not None for r in rows)
    same = [r.score for r in rows if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
    empty = {r.score for r in rows if r.doc_id in (900, 901)}
    assert len(empty) == 1 and empty.pop() < 0.3
    assert [r.predicted for r in rows if r.doc_id == 902] == [1]
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score(table.limit(0), given).collect() == []
    assert toxicity.score(table, given.limit(0)).count() == 306


def test_forms_and_votes():
    counts = word_counts("You IDIOT, idiot! Worthlessness")
    assert counts == {"you": 1, "idiot": 2, "worthlessness": 1}
    forms = forms_of(counts)
    assert forms["=idiot"] == 2 and forms["idi*"] == 2 and forms["worthles*"] == 1 and "you*" in forms and "idiotx*" not in forms
    names = ["=idiot", "wort*", "zzz*"]
    assert Lexicon(names).held(counts) == {0: 2, 1: 1}
    votes = toxicity.fixed_votes("You IDIOT, idiot!!!", word_counts("You IDIOT, idiot!!!"))
    assert len(votes) == FIXED and votes[0] and votes[1] and not votes[6]
    long = "ab cd\n" * 400_000
    assert word_counts(long) == {"ab": 400_000, "cd": 400_000}


def simulated(n, seed=1):
    """Votes of seven voters: five independent ones, and two copies of the fifth."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    accuracy = np.array([0.9, 0.85, 0.8, 0.75, 0.7])
    x = (rng.random((n, 5)) < np.where(y[:, None], accuracy, 1 - accuracy)).astype(np.uint8)
    return np.concatenate([x, x[:, 4:], x[:, 4:]], axis=1), y


def test_label_model_finds_accuracies_and_copies():
    x, y = simulated(20_000)
    gold, ones = np.where(np.arange(len(y)) < 2000, y, -1).astype(int), np.ones(len(y), np.int64)
    plain = LabelModel([False, True], 7)
    plain.fit(plain.sums(x[:2000], gold[:2000], ones[:2000]))
    tree = LabelModel([False, True], 7)
    tree.depend(plain.pair_sums(x, gold, ones), least=0.02)
    linked = {frozenset((i, int(p))) for i, p in enumerate(tree.parent) if i != p}
    assert len([e for e in linked if e <= {4, 5, 6}]) == 2
    tree.fit(tree.sums(x, gold, ones, by=plain))
    for _ in range(30):
        tree.fit(tree.sums(x, gold, ones))
    free = [i for i in range(4) if tree.parent[i] == i]
    assert free and np.allclose(np.exp(tree.rates)[1, free, 0, 1], np.array([0.9, 0.85, 0.8, 0.75])[free], atol=0.04)
    for _ in range(30):
        plain.fit(plain.sums(x, gold, ones))
    none = np.full(len(y), -1)
    right = [((m.posterior(x, none) > 0.5) == y).mean() for m in (tree, plain)]
    assert right[0] > 0.9 > 0.8 > right[1]


def test_seeds_are_voters_that_fire_apart():
    x = np.zeros((300, 4), np.uint8)
    x[:40, 0] = x[:38, 1] = 1  # two voters of one kind of text
    x[40:60, 2] = 1  # one of another kind
    x[100:103, 3] = 1
    gold, ones = np.where(np.arange(300) < 60, 1, 0), np.ones(300, np.int64)
    model = LabelModel.seeded(toxicity.label_sums(x, gold, ones), 4)
    assert model.toxic.tolist() == [False, False, True, True, True] and np.exp(model.shares).sum() == pytest.approx(1)
    assert np.exp(model.rates)[2, :, 0, 1].round(1).tolist() == [1.0, 0.9, 0.0, 0.0] and np.exp(model.rates)[3, 2, 0, 1] > 0.9
    p = model.posterior(x, np.full(300, -1))
    assert (p[:60] > 0.9).all() and (p[103:] < 0.2).all()


def test_sums_do_not_depend_on_how_rows_are_cut():
    x, y = simulated(500)
    model, gold, ones = LabelModel([False, True], 7), np.full(500, -1), np.ones(500, np.int64)
    model.fit(model.sums(x, np.where(np.arange(500) < 50, y, -1).astype(int), ones))
    whole = model.sums(x, gold, ones)
    assert (whole == model.sums(x[:123], gold[:123], ones[:123]) + model.sums(x[123:], gold[123:], ones[123:])).all()


def test_classifier_separates(spark):
    rng = np.random.default_rng(2)
    rows = [([int(i) for i in np.flatnonzero(rng.random(6) < 0.4)],) for _ in range(400)]
    rows = [(f, toxicity.UNITS if 2 in f and 4 not in f else 0) for (f,) in rows]
    w = toxicity.classifier(spark.createDataFrame(rows, "f array<int>, y long"), 6)
    z = toxicity.margins(pa.array([f for f, _ in rows], pa.list_(pa.int32())), w)[0]
    assert ((z > 0) == np.array([y > 0 for _, y in rows])).all()
    assert w[2] == pytest.approx(max(w)) and w[4] < 0
