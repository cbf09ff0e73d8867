import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siftline.sources import files


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n  {"id": "b"}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(p), "id string, n long").orderBy("line_no").collect()
    assert [(r.id, r.n) for r in rows] == [("a", 1), ("b", None)]
    p.write_text("[1]\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "id string").collect()
    p.write_text("\n\n")
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(p), "id string", allow_empty=False)


def test_predictions(spark):
    rows = spark.createDataFrame([(0, "a", "x", None), (1, "a", "", "y"), (2, "b", None, None), (3, None, "z", None)], "line_no long, id string, text string, output string")
    assert {r.id: r.text for r in files.last_predictions(rows).collect()} == {"a": "y", "b": "", None: "z"}
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(ValueError, match="1 ids repeated, 0 missing, 0 extra"):
        files.strict_predictions(rows.where("id is not null"), ids)
    assert files.strict_predictions(rows.where("line_no in (0, 2)"), ids).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 1), ("c\nd", None)], "t string, n long")
    files.write_tsv(df, str(tmp_path / "t"))
    back = files.read_tsv(spark, str(tmp_path / "t"), ["t", "n"])
    assert {r.t for r in back.collect()} == {"a b", "c d"}
    with pytest.raises(ValueError):
        files.read_tsv(spark, str(tmp_path / "t"), ["x"])
    files.write_jsonl(df, str(tmp_path / "j"))
    with pytest.raises(Exception):
        files.write_jsonl(df, str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert {"t": "c\nd", "n": None} in lines


def test_digests(spark, tmp_path):
    p = tmp_path / "x.bin"
    p.write_bytes(b"\xff\xd8\xff123")
    files.require_digest(spark, str(p), hashlib.sha256(p.read_bytes()).hexdigest())
    with pytest.raises(ValueError):
        files.require_digest(spark, str(p), "0")
    assert [r.kind for r in files.uploads(spark, str(tmp_path), ("jpeg",), 100).collect()] == ["jpeg"]
    assert files.uploads(spark, str(tmp_path), ("png",), 100).count() == 0


def test_manifest(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "id string, family string")
    m = files.manifest(df, "family").first()
    assert (m.rows, m.ids, m.histogram) == (3, 3, {"x": 2, "": 1})
    assert files.manifest(df.repartition(3), "family").first().digest == m.digest != files.manifest(df.limit(2), "family").first().digest


def test_knowledge_base(spark, tmp_path):
    p = tmp_path / "kb.jsonl"
    item = {"id": "a", "city_code": "370000", "city_name": "甲市", "kind": "food", "name": "面", "text": "t", "source_title": "s", "source_url": "https://x.org/", "verified_on": "2024-01-01"}
    p.write_text(json.dumps(item, ensure_ascii=False) + "\n")
    assert files.knowledge_base(spark, str(p)).count() == 1
    p.write_text(json.dumps(item | {"kind": "x"}) + "\n")
    with pytest.raises(ValueError):
        files.knowledge_base(spark, str(p))


def test_public_fields(spark):
    df = spark.createDataFrame([((1, 2, 3),)], "s struct<b:int,a:int,secret:int>")
    assert files.public_fields(df, {"s": ["b", "a"]}).schema.simpleString() == "struct<s:struct<a:int,b:int>>"
    assert files.todo(df.select(F.lit("a").alias("id")), df.select(F.lit("a").alias("id"))).count() == 0


def test_settings(tmp_path):
    from siftline.sources.config import load_settings

    p = tmp_path / "env"
    p.write_text("# note\nA=1\n B = 'x y' \nC=\"\n\nA=2\nnothing\n")
    into = {"B": "kept"}
    assert load_settings(str(p), into) == {"A": "2", "B": "x y", "C": '"'} and into == {"A": "2", "B": "kept", "C": '"'}
    assert load_settings(str(tmp_path / "no"), into) == {}


def test_labelling_resumes(spark, tmp_path):
    from siftline.plans.labelling import CallFailed, resume, with_retries

    waits, answers = [], iter([CallFailed(503), CallFailed(None), ("ok", [])])

    def flaky(_):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert with_retries(flaky, "p", 3, waits.append) == ("ok", []) and waits == [0.8, 1.6]

    def call(prompt):
        if prompt == "bad":
            raise CallFailed(400)
        return prompt.upper(), [-1.0, -2.0]

    def never(prompt):
        if prompt != "bad":
            raise ValueError("asked again")
        return "late", [0.0]

    rows = spark.createDataFrame([("a", "x"), ("b", "bad")], "id string, prompt string")
    first = {r.id: r for r in resume(rows, call, str(tmp_path / "cache")).collect()}
    assert first["a"].label == "X" and first["b"].label is None and first["b"].note == "status 400" and 0 < first["a"].confidence < 1
    again = {r.id: r.label for r in resume(rows, never, str(tmp_path / "cache")).collect()}
    assert again == {"a": "X", "b": "late"}
