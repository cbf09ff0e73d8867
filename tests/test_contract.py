import json
import random

from pyspark.sql import functions as F

from siftline.functions import decisions
from siftline.operators.contract import contract_table, label_errors, with_decision

SCENES = list(decisions.INTENTS)


def values(rng):
    """A value of any kind that a slot or field might hold."""
    pick = [None, True, False, 0, 5, -3, 0.5, 1.0, 1.5, "", " ", "　\t", "text", "早饭", "礼貌", "拒绝", "超市", 'q"\\\n\u0007', "x" * 13, [], ["a"], ["a", " "], ["a", 1], [None], ["b"] * 9, {"k": 1}, {}]
    return rng.choice(pick)


def texts(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        scene = rng.choice([*SCENES, *SCENES, "weather", None, 3])
        intents = decisions.INTENTS.get(scene, ("none",)) if isinstance(scene, str) else ("none",)
        slots = {}
        for name, (kind, _, allowed) in decisions.SLOTS.get(scene if isinstance(scene, str) else "none", {}).items():
            if rng.random() < 0.8:
                good = {"strings": ["a", "b"], "enum": rng.choice(allowed or ("",)), "integer": 7, "string": "topic"}[kind]
                slots[name] = good if rng.random() < 0.7 else values(rng)
        if rng.random() < 0.15:
            slots[rng.choice(["x", "a b", "é"])] = values(rng)
        o = {"scene": scene, "intent": rng.choice([*intents, "rewrite"]), "complexity": rng.choice([0.25, 1, 0]), "confidence": 0.5, "need_cloud": rng.random() < 0.5, "slots": slots}
        for k in list(o):
            if rng.random() < 0.06:
                o[k] = values(rng)
            elif rng.random() < 0.03:
                del o[k]
        if rng.random() < 0.3:
            o["reason"] = rng.choice(["fine", "", 4, "r" * 61, None])
        if rng.random() < 0.1:
            o[rng.choice(["note", "{x}", "Ω"])] = 1
        if rng.random() < 0.3:
            o = dict(rng.sample(list(o.items()), len(o)))
        t = json.dumps(o, ensure_ascii=rng.random() < 0.5)
        out.append(rng.choice([t] * 8 + [f" \n{t}\t", f"```json\n{t}\n```", f"so {t} ok", t[:-1] + ",}", t + t]))
    return out + [None, "", "null", "[]", "3", '"a"', "{}", '{"a": 1, "a": 2}', '{"scene": "none", "scene": "chat"}', "{" * 50, '{"slots": 123456789012345678901234567890}', '{"complexity": NaN}', '{"complexity": 1e400}']


def test_every_field_as_the_python_rules_have_it(spark):
    rows = [(i, t) for i, t in enumerate(texts(700, 4))]
    df = spark.createDataFrame(rows, "i int, t string")
    for mode, profile, partial in (("salvage", "server", False), ("strict", "edge", False), ("salvage", "edge", True)):
        want = {r.i: r.d.asDict() for r in df.select("i", decisions.decision(F.col("t"), mode, profile, partial).alias("d")).collect()}
        got = {r.i: r.d.asDict() for r in with_decision(df, "t", mode=mode, profile=profile, partial=partial).collect()}
        for i, t in rows:
            assert got[i] == want[i], t
        assert len(got) == len(rows)


def test_well_formed_rows_pass_no_python(spark):
    good = json.dumps({"scene": "reading", "intent": "none", "complexity": 0, "confidence": 1, "need_cloud": False, "slots": {"text_length": 5, "source": "pdf"}})
    held = spark.createDataFrame([(good,)], "t string")
    plan = with_decision(held, "t")._jdf.queryExecution().optimizedPlan().toString()
    native, python = plan.split("ArrowEvalPython")[0], plan.count("ArrowEvalPython")
    assert python == 1 and "Union" in native and with_decision(held, "t").first().d.errors == []


def test_odd_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "{}", "x", 2)], "`a b` int, t string, scene string, d int")
    row = with_decision(df, "t").first()
    assert row["a b"] == 1 and row.scene == "x" and row.d.errors == ["bad_scene:"]
    assert with_decision(df.limit(0), "t").collect() == []
    assert contract_table(spark).count() == len(SCENES)


def test_label_errors(spark):
    kind = "id int, scene string, intent string, need_cloud boolean, slots string, checks array<string>"
    rows = [
        (1, "chat", "rewrite", True, '{"goal": "拒绝"}', ["scene", "need_cloud", "slots.goal"]),
        (2, "chat", "rewrite", None, '{"goal": "x", "y": 1}', ["need_cloud", "slots.relation", "mood"]),
        (3, "chat", "diet_advice", True, "{}", ["scene"]),
        (4, "sea", "none", True, "{}", ["scene"]),
        (5, "food", "none", True, "[]", ["scene"]),
        (6, "food", "none", True, '{"ingredients": ["a", 2]}', []),
        (7, None, None, None, None, None),
        (8, "none", "none", False, "{}", None),
    ]
    got = {r.id: r.errors for r in label_errors(spark.createDataFrame(rows, kind)).collect()}
    assert got == {
        1: [],
        2: ["unknown_slot:y", "not_allowed:goal", "unlabelled:need_cloud", "unlabelled:slots.relation", "unknown_check:mood"],
        3: ["bad_intent:"],
        4: ["bad_scene:"],
        5: ["slots_not_object:"],
        6: ["not_strings:ingredients", "no_checks:"],
        7: ["bad_scene:"],
        8: ["no_checks:"],
    }
