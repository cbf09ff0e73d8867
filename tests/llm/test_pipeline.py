import collections

import corpus_pipeline
from siftline.llm.decontaminate import decontaminate
from siftline.llm.mixing import mix_sizes
from siftline.llm.token_files import token_table
from siftline.session import table

from tests.llm.test_similar import roots

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        seen[name] = out.count()
        if name == "near_duplicates":
            before, after = docs.collect(), out.collect()
            first = {}
            for r, root in zip(before, roots([r.text for r in before])):
                first[root] = min(r.doc_id, first.get(root, r.doc_id))
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        if name == "decontamination":
            assert decontaminate(out, table(spark, SF, "benchmark")).where("contaminated").count() == 0
            assert seen["near_duplicates"] - out.count() == decontaminate(docs, table(spark, SF, "benchmark")).where("contaminated").count()
        if name == "mixing":
            words = lambda t: len((t or "").split())
            size = {r.doc_id: words(r.text) for r in docs.collect()}
            got = collections.Counter()
            for r in out.collect():
                got[r.doc_id] += words(r.text)
            assert all(got[d] <= 3 * size[d] for d in got)
            assert abs(sum(got.values()) - sum(size.values())) < 0.05 * sum(size.values())
        docs = out
    assert list(seen) == ["quality", "near_duplicates", "decontamination", "mixing"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def odd_rows(spark):
    """Null ids and texts, empty and blank texts, repeated rows, one id on two texts, one very long text, extra columns."""
    some = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, SF, "documents").limit(12).collect()]
    rows = some + some[:2] + [(some[0][0], some[5][1], "en", "s", 1), (None, some[3][1], "en", None, None), (None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0)]
    rows += [(9003, " \n\t", "en", "s", 3), (9004, "long words of many kinds " * 20_000, "en", "s", 1), (None, "only here", "en", "s", 9), (None, "only here", "en", "s", 9)]
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, d int, h string, root int")


def test_stages_on_odd_rows_and_empty_tables(spark):
    docs = odd_rows(spark)
    key = lambda r: (r.doc_id, r.text or "")
    given = collections.Counter(map(key, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        out = stage(spark, docs, SF).collect()
        if name == "token_ids":
            assert len(out) == sum(given.values()) and collections.Counter(r.doc_id for r in out) == collections.Counter(d for d, _ in given.elements())
            continue
        assert list(out[0].asDict()) == corpus_pipeline.COLUMNS
        got = collections.Counter(map(key, out))
        if name == "mixing":
            assert {d for d, _ in got} <= {d for d, _ in given} and all(t.split() for _, t in got)
            continue
        assert set(got) <= set(given)
        if name in ("quality", "decontamination"):
            assert all(got[k] == given[k] for k in got)  # repeats share their fate
        if name == "near_duplicates":
            assert set(got.values()) == {1}
            of = dict(zip(given, roots([t for _, t in given])))
            assert len(got) == len(set(of.values())) == len({of[k] for k in got})
        if name == "quality":
            assert all(t.split() for _, t in got)


def test_mixing_meets_each_source_to_half_a_word(spark):
    docs = table(spark, SF, "documents")
    words = lambda t: len((t or "").split())
    taken, want = collections.Counter(), {}
    for r in corpus_pipeline.mixing(spark, docs, SF).collect():
        taken[r.source] += words(r.text)
    for r in mix_sizes(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        want[r.source] = r.target
    assert set(taken) <= set(want) and all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
