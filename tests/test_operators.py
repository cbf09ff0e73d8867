import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import checks, dedup, evaluate, overlap, ranking, retrieval, select, traces
from siftline.operators.components import components
from siftline.plans.fixtures import kb_rows


def naive_cover(rows, budget, must=()):
    sums, picks = collections.defaultdict(float), []
    left = dict((i, (c, max(0.0, q))) for i, c, q in rows)
    for i in sorted(must)[:budget]:
        c, q = left.pop(i)
        sums[c] += q
        picks.append(i)
    while left and len(picks) < budget:
        gain, i = max(((math.sqrt(sums[c] + q) - math.sqrt(sums[c]), -i) for i, (c, q) in left.items()))
        if gain <= 0:
            break
        c, q = left.pop(-i)
        sums[c] += q
        picks.append(-i)
    return picks, sum(map(math.sqrt, sums.values()))


def test_cover_equals_the_loop(spark):
    rng = random.Random(5)
    for n, budget in ((25, 10), (40, 60)):
        rows = [(i, f"c{rng.randrange(6)}", rng.choice([0.0, 0.25, 0.5, 1.0, 2.0, -1.0])) for i in range(n)]
        df = spark.createDataFrame(rows, "idx int, cell string, quality double")
        picks, f = naive_cover(rows, budget)
        got = select.greedy_cover(df, budget).orderBy("pick").collect()
        assert [r.idx for r in got] == picks
        assert select.coverage_objective(select.greedy_cover(df, budget)).first().objective == pytest.approx(f)
        must = spark.createDataFrame([(3,), (7,), (11,)], "idx int")
        want, _ = naive_cover(rows, budget, (3, 7, 11))
        assert [r.idx for r in select.greedy_cover(df, budget, must=must).orderBy("pick").collect()] == want
        cut = naive_cover([r for r in rows if r[0] not in (3, 7, 11)], budget)[0]
        assert [r.idx for r in select.greedy_cover(df, budget, excluded=must).orderBy("pick").collect()] == cut


def naive_allocate(rows, budget):
    cells = sorted({r[1] for r in rows}, key=lambda c: min(r[0] for r in rows if r[1] == c))
    cap, floor = max(1, int(budget * 0.4)), max(1, int(budget * 0.25) // len(cells)) if int(budget * 0.25) else 0
    quota = hamilton([(b, w) for b, w in select.TARGET_MIX.items()], budget)
    best, used, picks = sorted(rows, key=lambda r: (-r[3], r[0])), collections.Counter(), []
    done = set()

    def take(r, stage):
        if len(picks) < budget and r[0] not in done and used[r[1]] < cap:
            done.add(r[0])
            used[r[1]] += 1
            picks.append((r[0], stage))
            return True
        return False

    for c in cells:
        for r in [r for r in best if r[1] == c][:floor]:
            take(r, "floor")
    bands = sorted({r[2] for r in rows}, key=lambda b: min(r[0] for r in rows if r[2] == b))
    of = {r[0]: r[2] for r in rows}
    while True:
        have = collections.Counter(of[i] for i, _ in picks)
        for b in sorted(bands, key=lambda b: -(quota[b] - have[b])):
            if quota[b] > have[b] and any(r[2] == b and take(r, "mix") for r in best):
                break
        else:
            break
    for r in best:
        take(r, "quality")
    return picks


def hamilton(weights, total):
    s = sum(w for _, w in weights)
    x = {k: total * w / s for k, w in weights}
    out = {k: math.floor(v + 1e-9) for k, v in x.items()}
    for k in sorted(x, key=lambda k: -(x[k] - out[k]))[: total - sum(out.values())]:
        out[k] += 1
    return out


def test_allocation_equals_the_loop(spark):
    rng = random.Random(9)
    for budget in (7, 20):
        rows = []
        for i in range(45):
            b = rng.choice(["easy", "medium", "hard"])
            rows.append((i, f"{b}{rng.randrange(3)}", b, rng.choice([0.1, 0.5, 0.9, 0.7])))
        df = spark.createDataFrame(rows, "idx int, cell string, band string, quality double")
        got = [(r.idx, r.stage) for r in select.allocate(df, budget).orderBy("pick").collect()]
        assert got == naive_allocate(rows, budget)
    with pytest.raises(ValueError):
        select.allocate(spark.createDataFrame([(1, "c", "easy", 1.0), (2, "c", "hard", 1.0)], df.schema), 2)


def test_largest_remainder(spark):
    df = spark.createDataFrame([("easy", 0.3, 0), ("medium", 0.5, 1), ("hard", 0.2, 2)], "k string, weight double, i int")
    got = {r.k: r.quota for r in select.largest_remainder(df, 60, tie=[F.col("i")]).collect()}
    assert got == {"easy": 18, "medium": 30, "hard": 12}
    rng = random.Random(2)
    for total in (0, 1, 13, 100):
        w = [(f"k{i}", float(rng.randrange(0, 9)), i) for i in range(7)]
        df = spark.createDataFrame(w, "k string, weight double, i int")
        got = select.largest_remainder(df, total, tie=[F.col("i")]).collect()
        assert {r.k: r.quota for r in got} == hamilton([(k, x) for k, x, _ in w], total)
    zero = spark.createDataFrame([("a", 0.0)], "k string, weight double")
    assert select.largest_remainder(zero, 5, tie=[F.col("k")]).first().quota == 0


def test_strata_refill(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(20)], "idx int, k string")
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, weight double")
    assert select.stratified(df, 10, ["k"], weights=w).count() == 8
    out = select.stratified(df, 10, ["k"], weights=w, refill=True)
    assert out.count() == 10 and out.select("idx").distinct().count() == 10


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


def grams(t):
    t = "".join((t or "").split()).lower()
    return {t[i : i + 3] for i in range(len(t) - 2)} if len(t) > 3 else ({t} if t else set())


def test_dedup_equals_all_pairs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 20, 60]))) for _ in range(60)] + ["", None, "ab", "A b"]
    for _ in range(50):
        t = rng.choice(texts[:60]).split()
        for _ in range(rng.choice([0, 1, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(rng.choice(["  ", "\n"]).join(t).upper())
    rows = [(i, t, float(i % 3)) for i, t in enumerate(texts)]
    g = [grams(t) for t in texts]
    sim = lambda i, j: len(g[i] & g[j]) / len(g[i] | g[j]) if g[i] | g[j] else 1.0
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sim(i, j) >= 0.8:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "idx long, text string, p double")
    out = {r.idx: r for r in dedup.deduplicate(df, priority=F.col("p")).collect()}
    assert len(out) == len(rows)
    for i in range(len(rows)):
        group = [j for j in range(len(rows)) if root(j) == root(i)]
        best = min(group, key=lambda j: (-rows[j][2], j))
        assert (out[i].component, out[i].representative, out[i].kept) == (root(i), best, i == best)
        assert out[i].jaccard is None if i == best else abs(out[i].jaccard - sim(i, best)) < 1e-4


def test_overlap(spark):
    refs = spark.createDataFrame([("a", "Hello, World 12", 0), ("b", "hello world１２", 1), ("c", "something else here", 2), ("e", "", 3)], "id string, text string, pos int")
    probes = spark.createDataFrame([("p", "HELLO world12!"), ("q", "something else there"), ("r", "zzz"), ("s", None)], "id string, text string")
    n = lambda df: overlap.normalised(df, id_col="id", text="text")
    r = n(refs).join(refs.select("id", "pos"), "id")
    assert {tuple(x) for x in overlap.exact_matches(n(probes), r).collect()} == {("p", "a"), ("p", "b"), ("s", "e")}
    assert {tuple(x) for x in overlap.exact_matches(n(probes), r, last_only=True).collect()} == {("p", "b"), ("s", "e")}
    for cap in (80, None):
        got = {x.id: x.ref for x in overlap.near_matches(n(probes), r, threshold=0.7, cap=cap).collect()}
        assert got == {"p": "a", "q": "c", "s": "e"}
    report = {(x.kind, x.id) for x in overlap.overlap_report(n(probes), r, threshold=0.7).collect()}
    assert report == {("EXACT", "p"), ("EXACT", "s"), ("NEAR", "q")}
    with pytest.raises(ValueError):
        overlap.disjoint_ids(refs, refs.limit(1))


def test_search(spark):
    kb = spark.createDataFrame(*kb_rows())
    ask = lambda *q: spark.createDataFrame([(f"q{i}", c, t) for i, (c, t) in enumerate(q)], "q string, city_code string, question string")
    got = retrieval.search(kb, ask(("370000", "当地有哪些特色美食"), ("370000", "塔有什么特点"), ("370000", "市长是谁"), ("1", "美食"))).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.q].append(r.id)
    assert by == {"q0": ["f1", "f2"], "q1": ["s1"]} or set(by["q0"]) == {"f1", "f2"} and by["q1"] == ["s1"] and len(by) == 2


def test_checks(spark):
    rows, schema = kb_rows()
    bad = [*rows, (9, "f1", "37", "丙", "shop", "", "t", "s", "http://x", "2024"), (10, "z", "420000", "别名", "food", "n", "t", "s", "https://x.org/", "2024-01-01")]
    got = collections.Counter((r.id, r.rule) for r in checks.knowledge_violations(spark.createDataFrame(bad, schema)).collect())
    assert got[("f1", "unique_id")] == 2 and got[("f1", "kind")] == 1 and got[("z", "one_name")] == 1 and got[("f3", "one_name")] == 1 and ("s1", "unique_id") not in got
    review = spark.createDataFrame([("a", "fam", "通过", None, "", "x"), ("b", "other", "修正", " ", "maybe", "x")], "id string, family string, status string, note string, need_cloud string, norm string")
    draft = spark.createDataFrame([("a", "fam"), ("b", "fam"), ("c", "fam")], "id string, family string")
    rules = {(r.id, r.rule) for r in checks.review_violations(review, draft, size=3).collect()}
    assert rules == {("a", "unique_text"), ("b", "unique_text"), ("b", "note"), ("b", "need_cloud"), ("b", "family"), ("c", "missing_id"), (None, "size")}
    t = spark.createDataFrame([("1", "现在还营业吗", "location", "nearby_hint", False), ("2", "减脂吃什么", "food", "recipe_lookup", False), ("3", "苹果新鲜吗", "food", "none", True)], "id string, u string, s string, i string, n boolean")
    found = {(r.id, r.rule) for r in checks.rule_audit(t, checks.target_audit(*map(F.col, "usin"))).collect()}
    assert found == {("1", "live_opening"), ("2", "diet"), ("3", "food_quality")}
    v = checks.range_violations(spark.createDataFrame([("1", "abc", 5), ("2", "", 50)], "id string, t string, n int"), {"t": ("length", (1, 3)), "n": ("between", (0, 10))})
    assert {(r.id, r.rule) for r in v.collect()} == {("2", "t"), ("2", "n")}


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(rows, "idx int, v int, g string").repartition(6)
    got = {r.idx: r.rank for r in ranking.global_rank(df, F.desc("v"), F.col("idx")).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    per = collections.defaultdict(list)
    for r in rows:
        per[r[2]].append(r[0])
    groups = sorted(per.values(), key=lambda x: x[0])
    want = [g[k] for k in range(max(map(len, groups))) for g in groups if k < len(g)]
    assert [r.idx for r in ranking.interleaved(df, "g", F.col("idx")).orderBy("seq").collect()] == want


def test_traces(spark):
    rows = [("a", "edge", True, 100, {"x": 3, "y": 1}), ("b", "cloud", False, 900, {}), ("c", "cloud", True, 300, {"x": 0})]
    df = spark.createDataFrame(rows, "id string, executor string, success boolean, total_ms long, stages map<string,long>")
    s = traces.trace_stats(df).first()
    assert (s.total, s.edge, s.cloud, s.failed, s.mean_ms) == (3, 1, 2, 1, 200.0) and s.cloud_share == pytest.approx(2 / 3)
    empty = traces.trace_stats(df.where("false")).first()
    assert empty.mean_ms is None and empty.cloud_share == 0
    assert {(r.id, r.stage, r.share) for r in traces.stage_shares(df).collect()} == {("a", "x", 0.75), ("a", "y", 0.25), ("c", "x", 0.0)}


def test_top_errors(spark):
    df = spark.createDataFrame([(0, ["b:x", "a:y"]), (1, ["a:z"]), (2, [])], "idx int, errors array<string>")
    assert [tuple(r) for r in evaluate.top_errors(df, 2).collect()] == [("a", 2), ("b", 1)]
    assert evaluate.markdown("t", {"a": 1, "b": None}).splitlines()[-1] == "| b | — |"


def test_soft_labels_and_meta(spark):
    df = spark.createDataFrame([([("a", -0.5)],), ([("b", -1.0), ("c", -2.0)],)], "soft_label array<struct<token:string,logprob:double>>")
    s = traces.soft_label_stats(df).first()
    sizes = [len('[{"token": "a", "logprob": -0.5}]'), len('[{"token": "b", "logprob": -1.0}, {"token": "c", "logprob": -2.0}]')]
    assert (s.rows, s.tokens, s.mean_bytes) == (2, 3, round(sum(sizes) / 2, 1))
    m = df.select(traces.response_meta(F.lit("m"), F.lit(5), F.create_map(F.lit("a"), F.lit(1)), F.lit(0.12345), F.lit("r")).alias("m")).first().m
    assert m.model == "m" and m.confidence == 0.1235
