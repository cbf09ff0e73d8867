import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators import ranking, select
from siftline.streaming import chains, machines


def rows(n, seed):
    """One group holds two thirds of all rows; some keys and values are null, many rows repeat."""
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None]), rng.choice([None, *[rng.randrange(40) / 4.0] * 9]), rng.randrange(50)) for i in range(n)]


def frame(spark, n=2000, seed=1):
    return spark.createDataFrame(rows(n, seed), "i long, g string, v double, w long").repartition(7)


def test_group_ranks_are_row_numbers(spark):
    df = frame(spark)
    by = W.partitionBy("g").orderBy(F.desc("w"), "i")
    want = {r.i: (r.rank, r.n) for r in df.withColumn("rank", F.row_number().over(by)).withColumn("n", F.count("*").over(W.partitionBy("g"))).collect()}
    got = {r.i: (r.rank, r.n) for r in ranking.group_rank(df, ["g"], F.desc("w"), F.col("i"), size="n").collect()}
    assert got == want
    pairs = ranking.group_rank(df, ["g", "w"], F.col("i")).where("rank = 1").count()
    assert pairs == df.select("g", "w").distinct().count()
    assert ranking.group_rank(df.limit(0), ["g"], F.col("i")).collect() == []


def test_no_task_holds_a_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = spark.range(20_000).select(F.lit("one").alias("g"), F.col("id").alias("i"))
        sizes = [r.n for r in ranking.group_rank(df, ["g"], F.col("i")).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "3")


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.99, 1.0])
def test_percentiles_match_the_built_in_one(spark, q):
    df = frame(spark)
    want = {r.g: (r.n, r.m, r.p) for r in df.where("v IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.expr(f"percentile(v, {q})").alias("p")).collect()}
    got = {r.g: (r.n, r.mean, r["at"]) for r in ranking.group_percentiles(df, ["g"], "v", q).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)


def test_draws_keep_few_rows_and_lose_none(spark):
    hashed = spark.range(5000).select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("trial"), "id")
    hashed = hashed.withColumn("h", F.md5(F.concat_ws("|", "trial", "id").cast("binary")))
    under = select.smallest_hashes(hashed, 20, 100, 5000)
    assert under.count() < 3 * 20 * 100
    best = W.partitionBy("trial").orderBy("h")
    top = lambda df: {(r.trial, r.id) for r in df.withColumn("r", F.row_number().over(best)).where("r <= 100").collect()}
    assert top(under) == top(hashed)
    assert select.smallest_hashes(hashed, 20, 6000, 5000).count() == 100_000
    assert top(select.smallest_hashes(hashed, 20, 100, 5000, wide=0.01)) == top(hashed)


def stepped(times, gap):
    m = machines.Throttle(gap)
    return [m.step(t)[0] for t in times]


@pytest.mark.parametrize("gap", [0, 1, 7, 1000])
def test_chains_are_the_machine_s_steps(spark, gap):
    rng = random.Random(gap)
    events = [(i, rng.choice(["a", "hot", "hot", "hot", None]), float(rng.randrange(400)) / 2) for i in range(600)]
    df = spark.createDataFrame(events, "seq long, key string, ts_seconds double").repartition(5)
    got = {r.seq: r.passed for r in machines.throttled(df, seq="seq", gap=gap).collect()}
    for key in ("a", "hot", None):
        mine = sorted((t, i) for i, k, t in events if k == key)
        assert [got[i] for _, i in mine] == stepped([t for t, _ in mine], gap)
    assert machines.throttled(df.limit(0), seq="seq", gap=gap).collect() == []


def test_one_key_of_very_many_events(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("seq"), F.lit("one").alias("key"), (F.floor(F.col("id") * 37 / 10) + F.pmod(F.hash("id"), F.lit(3))).cast("double").alias("ts_seconds"))
    times = [r.t for r in df.select(F.col("ts_seconds").alias("t")).orderBy("ts_seconds", "seq").collect()]
    assert machines.throttled(df, seq="seq", gap=11).where("passed").count() == sum(stepped(times, 11))


def test_pointers(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 5), ("a", 4, 9), ("b", 1, 100)], "key string, n long, t long")
    got = sorted((r.key, r.n, r.nxt) for r in chains.next_events(df, 5).collect())
    assert got == [("a", 1, 2)]
    assert sorted((r.key, r.n, r.nxt) for r in chains.next_events(df, 4).collect()) == [("a", 1, 2), ("a", 2, 4), ("a", 3, 4)]
