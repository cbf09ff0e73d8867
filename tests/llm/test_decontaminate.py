import hashlib
import random
import re

from siftline.llm.decontaminate import build_index, decontaminate, proximity_matches

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ws(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, tests, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, ids = ws(text), set(), set()
        for item_id, item in tests:
            x = ws(item)
            size = min(window, len(x))
            for a in range(len(x) - size + 1) if x else ():
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == x[a : a + size]:
                        hit.update(range(b, b + size))
                        if item_id is not None:
                            ids.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, tests, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as term", "2 as pos", "'x' as word", "3 as h")
    t = spark.createDataFrame(tests, "item_id long, text string").selectExpr("*", "1 as item", "2 as j")
    rows = decontaminate(d, t, **options).drop("hash").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["of", "the", "The", "É", "naïve", "x1"] + [f"w{i}" for i in range(30)]
    tests = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 5, 13, 14, 30])))) for i in range(15)]
    tests += [(99, "of of of of of of of of of of of of of of of"), (None, "no id here but thirteen words are in this one item as it is"), (50, None), (51, ""), (52, "...")]
    tests += [tests[3]]
    docs = [(None, None), (0, ""), (1, "..."), (2, None)]
    for i in range(3, 50):
        parts = [" ".join(rng.choices(vocab, k=rng.randrange(40))) for _ in range(3)]
        if i % 3:
            x = ws(rng.choice(tests)[1])
            parts.insert(1, ", ".join(x[rng.randrange(3) :]))
        docs.append((i, "\n".join(parts)))
    docs += [docs[7], (7, "another text under a used id"), (60, "of " * 40), (None, "of " * 20)]
    docs += [(61, "filler " * 20000 + (tests[0][1]))]
    assert run(spark, docs, tests) == brute(docs, tests)
    assert run(spark, docs, tests, window=4) == brute(docs, tests, 4)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, 0, empty, False)]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "blue x red y green"), (3, "red green"), (4, "red " + "x " * 50 + "green blue"), (None, "green red blue")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "red green blue")], "item_id long, text string")
    index = build_index(docs, tests)
    assert {r.d for r in proximity_matches(index, 2, window=3).collect()} == {1, 2, None}
    assert {r.d for r in proximity_matches(index, 0, window=3).collect()} == {1, None}
    assert proximity_matches(index, 60, window=3).select("d").distinct().count() == 4


def test_proximity_over_all_terms(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "h g f e d c b a"), (3, "a b c d e f g"), (4, "a b c h" + " x" * 30 + " d e f g")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "a b c d e f g h")], "item_id long, text string")
    assert {r.d for r in proximity_matches(build_index(docs, tests), 4).collect()} == {1, 2}
