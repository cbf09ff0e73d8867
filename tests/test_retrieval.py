import random

import pytest
from pyspark.sql import functions as F

from siftline import broadcasts
from siftline.functions.text import retrieval_tokens
from siftline.operators import retrieval
from siftline.scratch import stored

WORDS = ["sea", "old", "tower", "noodle", "x", "y", "zz", "塔", "面条", "古城", "a1", "of", "the", "the", "the"]


def knowledge(rng, n):
    rows = []
    for i in range(n):
        city = rng.choice(["c1", "c1", "c2"])
        words = [rng.choice(WORDS) for _ in range(rng.choice([1, 3, 8, 40]))]
        rows.append((f"i{i:03d}", city, city.upper() + "市", rng.choice(["food", "sight"]), rng.choice(["塔", "old tower", "面", "q" + str(i)]), " ".join(words)))
    return rows


def asked(rng, n):
    out = []
    for i in range(n):
        words = [rng.choice(WORDS + ["美食", "景点", "old tower", "C1市"]) for _ in range(rng.choice([1, 2, 5]))]
        out.append((f"q{i:03d}", rng.choice(["c1", "c2", "c9"]), " ".join(words)))
    return out


def brute_search(kb, questions, found, limit):
    """Every item of the city against every question, with the scores of :func:`retrieval.scores`."""
    out = []
    for q, city, text in questions:
        names = {r[2] for r in kb if r[1] == city}
        if not names:
            continue
        place = min(names)
        query = text.replace(place, "").replace(place.removesuffix("市"), "")
        food, sight = (any(w in query for w in words) for words in (retrieval.FOOD, retrieval.SIGHT))
        kind = "food" if food and not sight else "sight" if sight and not food else ""
        rows = []
        for i, c, _, k, name, _ in kb:
            if c != city:
                continue
            score, long = found.get((q, i), (0.0, False))
            named = name in text
            if (k == kind) if kind else (named or long):
                total = score + 3.0 * (kind != "") + 8.0 * named
                if total > 0.05:
                    rows.append((-round(total, 4), i))
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(rows)[:limit])]
    return sorted(out)


@pytest.mark.parametrize("seed, champions, blocks", [(1, 8, 16), (2, 1, 3), (3, 1, 1)])
def test_search_is_what_all_items_give(spark, monkeypatch, seed, champions, blocks):
    monkeypatch.setattr(retrieval.best_scores, "__kwdefaults__", retrieval.best_scores.__kwdefaults__ | {"champions": champions, "blocks": blocks})
    rng = random.Random(seed)
    kb, questions = knowledge(rng, 150), asked(rng, 60)
    base = spark.createDataFrame(kb, "id string, city_code string, city_name string, kind string, name string, text string")
    asks = spark.createDataFrame(questions, "q string, city_code string, question string")
    names = base.groupBy("city_code").agg(F.min("city_name").alias("city_name"))
    terms = asks.join(names, "city_code").select("q", F.col("city_code").alias("grp"), retrieval_tokens(retrieval.searchable(retrieval.without_place(F.col("question"), F.col("city_name")))).alias("terms"))
    all_ = retrieval.scores(base, terms, group="city_code", doc="id", text=F.concat_ws(" ", "name", "text")).collect()
    want = brute_search(kb, questions, {(r.q, r.doc): (r.score, r.long_match) for r in all_}, 4)
    got = sorted(map(tuple, retrieval.search(base, asks).collect()))
    assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in want]
    assert [s for *_, s, _ in got] == pytest.approx([s for *_, s, _ in want], abs=1e-4)


def test_bounds_leave_few_documents(spark):
    rng = random.Random(5)
    docs = [(i, "all", " ".join(["common"] * rng.randrange(1, 4) + [rng.choice(["rare", "other", "more"]) for _ in range(3)] * (i % 40 == 0))) for i in range(2000)]
    frame = spark.createDataFrame(docs, "id int, g string, text string")
    asks = spark.createDataFrame([("q", "all", ["common", "rare"])], "q string, grp string, terms array<string>")
    posts = retrieval.weighed(frame, asks.select("grp", F.explode("terms").alias("term")), group="g", doc="id", text=F.col("text"))
    best = retrieval.best_scores(posts, asks, 5).collect()
    full = sorted(((-round(r.score, 9), r.doc) for r in retrieval.scores(frame, asks, group="g", doc="id", text=F.col("text")).collect()))
    assert sorted((-round(r.score, 9), r.doc) for r in best)[:5] == full[:5]
    assert len(best) < 60 and len(full) == 2000


def test_no_rows_and_no_terms(spark):
    kb = spark.createDataFrame(knowledge(random.Random(1), 5), "id string, city_code string, city_name string, kind string, name string, text string")
    asks = spark.createDataFrame([("q1", "c1", ""), ("q2", None, "sea")], "q string, city_code string, question string")
    assert retrieval.search(kb.limit(0), asks).collect() == []
    assert retrieval.search(kb, asks).collect() == []


def test_many_items_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    """Before, tables that were counted and found too large were left to Spark, which broadcast them: their files are small."""
    many = broadcasts.small(stored(spark.range(3000).selectExpr("'same' AS k", "id % 3 AS i")), 24, limit=1000)
    plan = spark.range(40).selectExpr("id AS i").join(many, "i")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    written = []
    monkeypatch.setattr(retrieval, "stored", lambda df, name="stored": written.append(name) or stored(df, name))
    rng = random.Random(3)
    kb = spark.createDataFrame(knowledge(rng, 20), "id string, city_code string, city_name string, kind string, name string, text string")
    retrieval.search(kb, spark.createDataFrame(asked(rng, 5), "q string, city_code string, question string"))
    assert "placed" in written and "wanted" not in written  # a row for each chosen item and term of the question
