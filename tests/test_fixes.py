from pyspark.sql import functions as F

from siftline.sources import files
from siftline.streaming.machines import PlaceChange


def test_a_blank_destination_is_none():
    for goal in (None, "", "  "):
        m = PlaceChange(destination=goal)
        assert [m.step(*x)[0] for x in (("a", 0), ("b", 1000), ("b", 61_000), ("a", 62_000), ("a", 200_000), ("a", 1))] == ["first", "candidate", "entered", "candidate", "revisited", "late"]
    m = PlaceChange(destination="c")
    assert [m.step(*x)[0] for x in (("a", 0), ("b", 0), ("b", 60_000), ("c", 70_000), ("c", 130_000), ("d", 140_000), ("a", 141_000), ("d", 142_000))] == ["first", "candidate", "passing", "candidate", "entered", "candidate", "candidate", "candidate"]


def test_lines_of_blanks_are_skipped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\t\n \x0b\n\t{"x": 2} \n')
    assert [r.x for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").orderBy("line_no").collect()] == [1, 2]


def test_numbers_follow_the_order_over_partitions(spark):
    rows = spark.range(500).repartition(7).withColumn("k", F.col("id") * 37 % 500).drop("id")
    assert [r.id for r in files.numbered(rows, "p", "k").orderBy("k").collect()] == [f"p_{i:04d}" for i in range(1, 501)]
