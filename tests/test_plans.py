import random

import duckdb
import pytest

import __spark_entry__ as entry_module
from siftline.plans import curation
from siftline.plans.fixtures import decision_text
from siftline.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["idx", "component", "representative", "kept", "jaccard"] and df.count() > 0


@pytest.mark.parametrize("name", ["dedup_documents", "coverage_select", "allocate_mix", "overlap_near_capped", "kb_answers", "kb_violations", "eval_lenient", "eval_strict", "template_expansion", "throttle_replay", "bounded_event_log", "document_manifest"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "orders", "events", "region", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(tuple(repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v if v == v else None) for v in r) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_curation(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        scene = rng.choice(["chat", "none"])
        label = decision_text(scene=scene, goal=rng.choice(["接受", "拒绝"])) if i % 15 else "broken"
        words = "".join(rng.choices("甲乙丙丁戊己庚辛壬癸子丑寅卯", k=20))
        rows.append((i, f"s{i:03d}", scene, "rewrite" if scene == "chat" else "none", words if i % 10 or not i else rows[-1][4], label, rng.random() if i % 4 else None, rng.random(), rng.random(), 100 + i))
    df = spark.createDataFrame(rows, "idx long, id string, scene string, intent string, utterance string, label string, consistency double, confidence double, agreement double, latency_ms long")
    out = curation.curate(df, 30, 20)
    train, gold = out.train.collect(), out.gold.collect()
    assert len(train) == 30 and len(gold) == 20
    assert not {r.id for r in train} & {r.id for r in gold}
    kept = {r.idx for r in out.dedup.collect() if r.kept}
    assert all(r.source_idx in kept for r in train)
    assert out.reports["labels"].first().invalid == 8
    assert out.reports["mix"].count() == 3 and out.reports["objective"].first().objective >= out.reports["baseline"].first().objective
    m = curation.messages(out.train, "{contract}|{signals}|{utterance}").first()
    assert [x.role for x in m.messages] == ["user", "assistant"]
    assert curation.training_rows(out.train).count() == 30 and curation.gold_rows(out.gold).count() == 20
