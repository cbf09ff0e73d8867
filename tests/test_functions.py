import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import coerce, decisions, records, signals, text


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_shingles_in_both_forms(spark):
    rows = [("",), ("ab",), ("abc",), ("abcd",), ("aaaa",)]
    a, b = text.shingles(F.col("t")), text.shingles(F.col("t"), empty="self", short_at=2)
    got = values(spark, "t string", rows, a, b)
    assert [sorted(x) for x, _ in got] == [[], ["ab"], ["abc"], ["abc", "bcd"], ["aaa"]]
    assert [sorted(x) for _, x in got][:3] == [[""], ["ab"], ["abc"]]


def test_normal_forms(spark):
    got = values(spark, "t string", [("Ａ b　C\n１",), (None,)], text.dedup_normal(F.col("t")), text.overlap_normal(F.col("t")))
    assert got == [("ａbc１", "abc1"), (None, None)]


def test_jaccard_of_empty_sets(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"])]
    assert [r[0] for r in values(spark, "a array<string>, b array<string>", rows, text.jaccard(F.col("a"), F.col("b")))] == [1.0, 0.0, 1 / 3]


def test_retrieval_tokens(spark):
    got = values(spark, "t string", [("KFC 八大关 x1",), ("",), (None,)], text.retrieval_tokens(F.col("t")))
    assert got[0][0] == ["kfc", "八", "大", "关", "八大", "大关", "x1"] and got[1][0] == [] == got[2][0]


def test_split_list(spark):
    rows = [("a，b,c",), ("a, b、c",), ("a、 b",), ("a",), ("",)]
    assert [r[0] for r in values(spark, "t string", rows, text.split_list(F.col("t")))] == [["a", "b,c"], ["a", "b、c"], ["a", "b"], ["a"], []]


def test_difficulty_and_quality(spark):
    rows = [(None, None, None, True), (1.0, None, None, True), (0.5, 0.5, 1.0, True), (0.2, 0.9, 0.1, False)]
    d = signals.difficulty(F.col("a"), F.col("b"), F.col("c"))
    got = values(spark, "a double, b double, c double, v boolean", rows, d, signals.quality(F.col("v"), F.col("b"), F.col("c")), signals.band(d))
    assert got[0] == (0.5, 0.775, "medium") and got[1][0] == 0 and got[3][1] == 0.0
    assert got[2][0] == pytest.approx((0.4 * 0.5 + 0.3 * 0.5) / 1.0)


def test_band_edges(spark):
    assert [r[0] for r in values(spark, "x double", [(0.3399,), (0.34,), (0.67,)], signals.band(F.col("x")))] == ["easy", "medium", "hard"]


def test_interpolated_percentile(spark):
    rows = [([1.0, 2.0, 5.0],), ([3.0],), ([],)]
    got = [r[0] for r in values(spark, "x array<double>", rows, signals.interpolated(F.col("x"), 0.1))]
    assert got[0] == pytest.approx(1.2) and got[1:] == [3.0, None]


def test_pairwise_consistency(spark):
    rows = [([["a", "b"], ["a", "b"], ["a"]],), ([["a"], None],), ([],)]
    got = [r[0] for r in values(spark, "x array<array<string>>", rows, signals.pairwise_consistency(F.col("x")))]
    assert got[0] == pytest.approx((1 + 0.5 + 0.5) / 3) and got[1:] == [None, None]


def test_json_bytes(spark):
    rows = [({"a": "x, y: z", "b": "é"},)]
    n = values(spark, "m struct<a:string,b:string>", [(("x, y: z", "é"),)], signals.json_bytes(F.col("m")))[0][0]
    assert n == len(json.dumps(rows[0][0], ensure_ascii=False).encode())


GOOD = {"scene": "reading", "intent": "summarize", "complexity": 0.5, "confidence": 1, "need_cloud": False, "slots": {"text_length": 5, "source": "text"}}


def test_contract():
    check = lambda **more: decisions.violations(GOOD | more)
    assert check() == []
    assert check(complexity=True) == ["not_number:complexity"]
    assert check(confidence=1.5) == ["out_of_range:confidence"]
    assert check(slots={"text_length": 5.0, "source": "text"}) == ["not_integer:text_length"]
    assert check(slots={"text_length": 5}) == ["missing_slot:source"]
    assert decisions.violations(GOOD | {"slots": {"text_length": 5}}, partial=True) == []
    assert check(slots={"text_length": True, "source": "fax", "x": 1}) == ["unknown_slot:x", "not_integer:text_length", "not_allowed:source"]
    assert check(slots=[]) == ["slots_not_object:"] and check(scene="x", more=1) == ["unknown_field:more", "bad_scene:"]
    assert check(scene=["a"]) == ["bad_scene:"] and decisions.violations([1]) == ["not_object:"]
    food = {"scene": "food", "intent": "none", "slots": {"ingredients": ["a"] * 9, "meal": "brunch"}}
    assert decisions.violations(GOOD | food) == ["too_many:ingredients", "not_allowed:meal"]
    edge = {"reason": "x" * 61, "slots": {"text_length": -1, "source": "text", "topic": " "}}
    assert decisions.violations(GOOD | edge) == [] and decisions.violations(GOOD | edge, "edge") == ["too_long:reason", "negative:text_length", "blank:topic"]


def test_salvage():
    s = decisions.salvage
    assert s('```json\n{"a": 1}\n```')[1] == {"a": 1}
    assert s('well {"a": {"b": "}"}} bye {"c": 2}')[1] == {"a": {"b": "}"}}
    assert s('{"a": [1,], "b": ",}",}')[1] == {"a": [1], "b": ",}"}
    assert s("[1, 2]") == (True, [1, 2]) and s("none") == (False, None) and s(None) == (False, None)
    assert decisions.strict('{"a": 1} tail') == (False, None) and decisions.strict(' {"a": 1, "a": 2} ')[1] == {"a": 2}


def test_decision_column(spark):
    rows = [(json.dumps(GOOD),), (None,), ("x " + json.dumps(GOOD),), ("[]",)]
    df = spark.createDataFrame(rows, "t string").select(decisions.decision(F.col("t")).alias("d"), decisions.decision(F.col("t"), "strict").alias("s"))
    got = df.select("d.scene", "d.errors", "s.errors", "d.is_object", decisions.cell(F.col("d.scene"), F.col("d.intent"), F.lit("easy"), F.col("d.slots"))).collect()
    assert tuple(got[0]) == ("reading", [], [], True, "reading|summarize|easy|source+text_length")
    assert got[1][1] == ["unparsed:"] and got[2][1] == [] and got[2][2] == ["unparsed:"] and got[3][1] == ["not_object:"]


def test_prompt(spark):
    out = values(spark, "s string, u string", [("sig {utterance}", "hi")], decisions.prompt(F.col("s"), F.col("u"), "{contract}\n{signals}\n{utterance}"))[0][0]
    assert out.startswith(decisions.contract_text()) and out.endswith("hi")
    with pytest.raises(ValueError):
        decisions.prompt(F.col("s"), F.col("u"), "{utterance}{utterance}")
    assert json.loads(decisions.json_schema())["required"][0] == "scene"


def test_coerce(spark):
    rows = [('["a", {"b": "c"}, null]',), ('"- x\\n* y"',), ("plain",), (None,)]
    got = values(spark, "t string", rows, coerce.json_text(F.col("t")), coerce.json_list(F.col("t")))
    assert got[0] == ("a\nb：c", ["a", "b：c"]) and got[1][1] == ["x", "y"] and got[2] == ("plain", ["plain"]) and got[3] == (None, None)
    assert values(spark, "t string", [('["a", {"text": "b"}, {"x": 1}]',)], coerce.json_content(F.col("t")))[0][0] == "ab"


def test_action_card(spark):
    source = "请于2026年10月29日 15:30提交报名表。"
    due = "2026-10-29T15:30:00+08:00"
    tasks = [("提交", "2026年10月29日 15:30提交报名表", due), ("别的", "没有这句", due), ("", "提交", None)]
    schema = "title string, source string, tasks array<struct<title:string,evidence:string,due_at:string>>"
    card = values(spark, schema, [("", source, tasks), ("t", source, None)], records.action_card(F.col("title"), F.col("tasks"), F.col("source")))
    assert [tuple(t) for t in card[0][0].tasks] == [("提交", due, tasks[0][1])] and card[0][0].title == "待办行动卡"
    assert card[1][0].tasks == [] and card[1][0].title == "t"
    for wrong in ("2026-10-30T15:30:00+08:00", "2026-10-29T15:30:00+09:00", "2026-10-29T15:30:00", "2026-10-29T15:31:00+08:00", "x"):
        assert values(spark, "d string, e string", [(wrong, tasks[0][1])], records.supported_due(F.col("d"), F.col("e")))[0][0] is None


def test_places(spark):
    rows = [("北京市", "[]", "110108", "海淀区"), ("湖北省", "", "429004", "仙桃市"), ("湖北省", "武汉市", "420106", "武昌区"), ("x", None, "12", None)]
    got = [r[0] for r in values(spark, "p string, c string, a string, d string", rows, records.city_code(*map(F.col, "pcad")))]
    assert [tuple(g) if g else None for g in got] == [("110000", "北京市"), ("429004", "仙桃市"), ("420100", "武汉市"), None]
    rows = [("110000", "110108"), ("110000", "120101"), ("429004", "429005"), ("420100", "420106"), ("420100", "420200")]
    assert [r[0] for r in values(spark, "c string, a string", rows, records.same_place(F.col("c"), F.col("a")))] == [True, False, False, True, False]


def test_hosts_and_windows(spark):
    hosts = ["10.0.0.1", "172.16.9.9", "172.32.0.1", "192.168.1.1", "8.8.8.8", "localhost", "a.local", "300.1.1.1", None]
    assert [r[0] for r in values(spark, "h string", [(h,) for h in hosts], records.private_host(F.col("h")))] == [True, True, False, True, False, True, True, False, False]
    rows = [(60, 1380, 420), (600, 1380, 420), (600, 540, 660), (5, 7, 7)]
    assert [r[0] for r in values(spark, "m int, a int, b int", rows, records.in_window(*map(F.col, "mab")))] == [True, False, True, True]


def test_route(spark):
    rows = [(False, True, None, None, 0.9), (True, False, None, None, 0.9), (True, True, False, None, 0.9), (True, True, True, 0.9, 0.9), (True, True, None, 0.5, None), (True, True, True, 0.5, 0.61), (True, True, True, 0.85, 0.6)]
    got = [r[0].reason for r in values(spark, "a boolean, b boolean, c boolean, d double, e double", rows, records.route(*map(F.col, "abcde")))]
    assert got == ["not_ready", "not_preferred", "invalid", "too_complex", "no_confidence", "confident", "unsure"]


def test_small_formats(spark):
    c = F.col("x")
    rows = [(999,), (1000,), (None,)]
    assert [r[0] for r in values(spark, "x long", rows, records.duration(c))] == ["999 ms", "1.0 s", "—"]
    assert [r[0] for r in values(spark, "x int", [(200,), (401,), (429,), (503,), (500,), (418,), (None,)], records.error_class(c))] == ["ok", "auth", "limited", "upstream", "server", "client", "network"]
    assert values(spark, "x int", [(1,)], records.supervision_mask(F.lit(2), F.array(*map(F.lit, [7, 8, 9])), F.lit(5)))[0][0] == [-100, -100, 9, -100, -100]
    assert values(spark, "x string", [("food",)], records.lookup(c, records.SCENE_GROUPS, "unknown"))[0][0] == "food"
    now = 10**12
    assert [r[0] for r in values(spark, "x long", [(now - 30_000,), (now - 120_000,), (now - 3 * 86_400_000,)], records.relative_time(c, F.lit(now)))] == ["刚刚", "2 分钟前", "3 天前"]
    assert [r[0] for r in values(spark, "x binary", [(b"\xff\xd8\xff\xe0",), (b"%PDF-1.7",), (b"\x89PNG\r\n\x1a\n",), (b"GIF8",)], records.sniff(c))] == ["jpeg", "pdf", "png", None]
    assert values(spark, "x string", [("拒绝",)], records.offline_reply(c, F.lit("礼貌"), {("拒绝", True): "抱歉", ("拒绝", False): "不了"}, ("礼貌",), "好"))[0][0] == "抱歉"


def test_lsh_curve(spark):
    rng = random.Random(1)
    s = rng.random()
    assert values(spark, "x double", [(s,)], text.lsh_hit_probability(F.col("x"), 4, 32))[0][0] == pytest.approx(1 - (1 - s**4) ** 32)


def test_extra_keys_with_braces_are_written_as_they_are():
    assert decisions.violations(GOOD | {"{x}": 1}) == ["unknown_field:{x}"]
