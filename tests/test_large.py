"""What failed on large tables, on small ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import checks, contract, dedup, evaluate, overlap, retrieval
from siftline.streaming import chains


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_written_by_their_exact_value(spark):
    rows = spark.createDataFrame([(17 / 80,), (5 / 16,), (1.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(overlap.three_places(F.col("x"))).collect()] == ["0.212", "0.312", "1.000", None]


@pytest.mark.parametrize("cap, t", [(None, 0.2), (None, 0.78), (3, 0.05)])
def test_few_probes_meet_references_without_a_shuffle(spark, cap, t):
    words = ["abcdefghij", "abcdefghzz", "klmnopqrst", "klmnopqxyz", "ab", "", None, "abcdefghijklmnop"]
    sides = [spark.createDataFrame([(i, w) for i, w in enumerate(x)], "id long, text string") for x in (words, words[::-1] + words)]
    probes, refs = [overlap.normalised(x, id_col="id", text="text") for x in sides]
    few, many = (overlap.near_matches(probes, refs, threshold=t, cap=cap, limit=n) for n in (1 << 20, 0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() >= 7
    assert "Join" not in plan_of(few)  # before, every reference's shingles were shuffled with their bitmaps


def test_a_batch_keeps_the_best_of_all_its_parts(monkeypatch):
    monkeypatch.setattr(overlap, "MET", 2)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 20)) for _ in range(40)]
    tables = overlap.probe_tables([("p", sets[0]), ("q", sets[1])])
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:02}" for i in range(40)]), pa.array(sets, pa.list_(pa.int64()))], ["id", "grams"])
    got = [x[1:3] for x in overlap.batch_best(batch, *tables[0], 0.0, 5) if x[0] == "q"]
    want = sorted(((-len(np.intersect1d(sets[1], s)), f"{i:02}") for i, s in enumerate(sets)))[:5]
    assert got == [(r, -n) for n, r in want]


def test_chains_of_any_length_and_crowded_times(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [None, "a", "b", "c"][i % 4], float(t)) for i, t in enumerate(np.sort(rng.integers(0, 400, 900)))] + [(2000 + i, "alone", 10.0 * i) for i in range(70)]
    got = {r.seq: r.passed for r in chains.passes(spark.createDataFrame(rows, "seq long, key string, ts double"), key="key", ts="ts", order=["seq"], gap=10).collect()}
    last, want = {}, {}
    for seq, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[seq] = key not in last or t - last[key] >= 10
        last[key] = t if want[seq] else last[key]
    assert got == want


def test_no_frame_runs_to_the_end_of_its_partition(spark):
    """Such a frame is added up anew for every row: 40,000 events of one key took minutes."""
    rows = spark.range(10).selectExpr("'k' AS key", "id + 1 AS n", "id AS t")
    assert "currentrow$(), unboundedfollowing$()" not in plan_of(chains.next_events(rows, 3))


def test_a_decision_is_read_in_one_pass(spark):
    """As a filter before a union, the text was parsed anew for every use of its value."""
    rows = spark.createDataFrame([(1, '{"scene": "none"}', None), (2, "so {} ok", None)], "i int, t string, odd void")
    d = contract.with_decision(rows, "t", name="t")
    assert d.columns == ["i", "odd", "t"] and [(r.i, r.odd, r.t.is_object) for r in d.orderBy("i").collect()] == [(1, None, True), (2, None, True)]
    assert "parse_json" not in plan_of(d).lower()


def test_strict_fields_take_one_pass(spark):
    gold = spark.createDataFrame([("a", '{"scene": "none", "intent": "none", "need_cloud": true}', ["scene"])], "id string, expected string, checks array<string>")
    said = spark.createDataFrame([("a", '{"scene": "none", "intent": "none", "complexity": 0, "confidence": 1, "need_cloud": false, "slots": {}}')], "id string, text string")
    found = evaluate.strict_fields(evaluate.strict_rows(evaluate.judged(gold, said, mode="strict"), ("scene",)))
    assert sorted(map(tuple, found.collect())) == [("intent", 1, 1, 1.0), ("labeled_slots", 0, 0, None), ("need_cloud", 0, 1, 0.0), ("scene", 1, 1, 1.0)]
    assert plan_of(found).count("HashAggregate") <= 4  # one for each field before


def test_items_do_not_meet_by_their_city(spark):
    """A few codes were the key of a shuffle of all items with their texts."""
    names = ("id", "city_code", "city_name", "kind", "name", "text", "source_title", "source_url", "verified_on")
    rows = spark.createDataFrame([("1", "100000", "A", "food", "n", "text", "t", "https://a.b", "2024-01-05"), ("2", "100000", "B", "food", "n", "text", "t", "https://a.b", "2024-01-05"), ("3", None, "B", "food", "n", "", "t", "https://a.b", "2024-01-05")], ", ".join(f"{n} string" for n in names))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = checks.knowledge_violations(rows)
        assert sorted(map(tuple, found.collect())) == [("1", "one_name"), ("2", "one_name"), ("3", "city_code"), ("3", "fields")]
        assert "hashpartitioning(city_code" not in plan_of(found) and "SortMergeJoin" not in plan_of(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_are_added_up_where_documents_lie(spark):
    """Before, every pair of a question and a document was shuffled."""
    docs = spark.createDataFrame([("all", i, f"sea old tower {i % 3}") for i in range(20)], "g string, d long, t string")
    asks = spark.createDataFrame([("q", "all", ["sea", "1"])], "q string, grp string, terms array<string>")
    found = retrieval.scores(docs, asks, group="g", doc="d", text=F.col("t"))
    assert found.count() == 20 and "hashpartitioning(q" not in plan_of(found)


def test_normal_forms_are_made_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(text, "FEW", 2)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ｆｉ①", None, "", "ﬁ", "abc"])], "i int, t string").coalesce(1)
    assert [r[0] for r in rows.orderBy("i").select(text.nfkc(F.col("t"))).collect()] == ["fi1", None, "", "fi", "abc"]


def test_a_summary_needs_no_similarities(spark, monkeypatch):
    """Before, a summary compared the sets of all removed texts with those of their representatives."""
    texts = ["some words here", "some words  here", "some words here!", "other things", "", None, "x", "other things altogether"]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    whole = dedup.deduplicate(df)
    want, rows = dedup.removal_summary(whole).first(), sorted(map(tuple, whole.drop("jaccard").collect()))
    monkeypatch.setattr(dedup, "compared", None)
    found = dedup.decisions(df)
    assert sorted(map(tuple, found.collect())) == rows and dedup.removal_summary(found).first() == want and want.removed >= 3
