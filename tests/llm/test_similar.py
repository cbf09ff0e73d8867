import random
import re
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
from siftline.llm import common
from siftline.llm.similar import groups, keep_one_similar, prefixes, sets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}


def roots(texts):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)] + ["É", "it's"]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "one two"), (6, "a b c d e"), (7, "A b\nc d e")]
    line = " ".join(rng.choices(vocab, k=40))
    for i in range(10, 90):
        words = rng.choices(vocab, k=rng.choice([8, 60, 400]))
        docs.append((i, " ".join(words) + (" " + line if i % 2 else "")))
    for i in range(90, 330):
        words = docs[rng.randrange(8, len(docs))][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 5, 9]) * max(1, len(words) // 100)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    return docs + [docs[20]]


def test_links_are_all_pairs_by_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want, got = {}, {}
    for (d, _), r in zip(docs, roots([t for _, t in docs])):
        want.setdefault(r, set()).add(d)
    for r in groups(frame).collect():
        got.setdefault(r.root, set()).add(r.d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert sorted(r.doc_id for r in keep_one_similar(frame).collect()) == sorted(min(x) for x in want.values())


def test_stage_links_five_words_at_0_8(spark):
    docs = [(d, t, "en", "s", len(t or "")) for d, t in corpus()]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    assert len(kept) == len(set(roots([t for _, t, *_ in docs])))
    assert len(set(roots([r.text for r in kept]))) == len(kept)


class Rows:
    """Stands for a table: keeps what a worker would run."""

    sparkSession = sparkContext = property(lambda self: self)
    select = lambda self, *_: self
    broadcast = lambda self, value: type("Held", (), {"value": value})
    mapInArrow = lambda self, run, _: run


def test_workers_hold_little_beside_a_batch():
    rng = random.Random(3)
    text = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=400)) for _ in range(2000)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array(text)], ["d", "h", "text"])
    common_ones = (np.arange(1000, dtype=np.uint64), np.ones(1000, np.uint32))
    for run in (prefixes(Rows(), 5, common_ones), sets(Rows(), 5)):
        next(run([batch.slice(0, 10)]))
        tracemalloc.start()
        n = sum(len(out) for out in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 2000 and peak < 48 << 20


def test_freed_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("end"))
    assert [seen.append(x) or x for x in common.trimmed(lambda batches: (2 * x for x in batches))([1, 2])] == [2, 4]
    assert seen == [2, 4, "end"]
