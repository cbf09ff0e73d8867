import random

from siftline.streaming import machines
from siftline.streaming.logs import append_log, bounded_log, committed, log_view, read_bounded, replayed


def accepted(times, minute, day):
    m = machines.RateLimiter(minute, day)
    return [m.step(t)[0] for t in times]


def test_limiter_cases():
    assert accepted([0, 1, 59, 60], 2, 5) == [True, True, False, True]
    assert accepted([0, 1, 60, 86_400], 2, 2) == [True, True, False, True]


def test_limiter_equals_counting():
    rng = random.Random(1)
    times = sorted(rng.uniform(0, 3 * 86_400) for _ in range(400))
    times += sorted(times[-1] + rng.uniform(0, 600) for _ in range(100))
    kept, want = [], []
    for t in times:
        ok = sum(t - x < 60 for x in kept) < 3 and sum(t - x < 86_400 for x in kept) < 60
        want.append(ok)
        kept += [t] * ok
    assert accepted(times, 3, 60) == want


def entered(events, **options):
    m = machines.PlaceChange(**options)
    return [t for p, t in events if m.step(p, t)[1]]


def test_place_change_cases():
    assert entered([("420100", 0), *[("430600", t) for t in (120_000, 180_000, 240_000)], ("420100", 900_000), ("420100", 960_000)]) == [180_000]
    assert entered([("420100", 0), ("430600", 120_000), ("420100", 150_000), ("430600", 180_000), ("430600", 181_000), ("430600", 100_000), ("430600", 240_000)]) == [240_000]
    assert entered([("420100", 0), ("421200", 120_000), ("421200", 180_000), ("430600", 600_000), ("430600", 660_000)], destination="430600") == [660_000]
    assert entered([("420100", 0), ("430600", 120_000), ("430600", 180_000), ("430100", 240_000), ("430100", 300_000)]) == [180_000]


def events(spark):
    rng = random.Random(2)
    rows, t = [], 0
    for i in range(300):
        t += rng.randrange(1, 40)
        rows.append((i, f"k{rng.randrange(5)}", float(t), rng.choice(["p", "q"])))
    return rows


def test_streams_equal_their_batch_forms(spark, tmp_path):
    rows = events(spark)
    schema = "seq long, key string, ts_seconds double, city_code string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "cast(ts_seconds * 1000 as long) as ts_ms")
    for b in range(3):  # files are read in order of their time of change
        df.where(f"seq >= {100 * b} and seq < {100 * b + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cases = (
        lambda d, s: machines.rate_limited(d, seq="seq", per_minute=2, per_day=30, streaming=s),
        lambda d, s: machines.place_changes(d, key="key", order=["ts_ms", "seq"], confirm_ms=30_000, streaming=s),
        lambda d, s: machines.throttled(d, seq="seq", gap=60, streaming=s),
    )
    kind = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    for i, case in enumerate(cases):
        stream = case(replayed(spark, str(tmp_path / "in"), kind), True)
        q = stream.writeStream.format("memory").queryName(f"out{i}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(map(tuple, spark.table(f"out{i}").collect()))
        assert got == sorted(map(tuple, case(df, False).collect())) and len(got) == len(rows)


def test_log(spark, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    spark.createDataFrame([(i, i // 2) for i in range(10)], "seq long, ts long").write.parquet(src)
    append_log(replayed(spark, src, "seq long, ts long"), log, str(tmp_path / "cp")).awaitTermination(60)
    assert [r.seq for r in log_view(spark, log, 3).collect()] == [9, 8, 7]


def test_bounded_log_never_holds_more(spark, tmp_path):
    src, log, state = str(tmp_path / "src"), str(tmp_path / "log"), str(tmp_path / "state")
    kind = "seq long, ts long"
    for b in range(4):
        spark.createDataFrame([(10 * b + i, b) for i in range(10)], kind).coalesce(1).write.mode("append").parquet(src)
    bounded_log(replayed(spark, src, kind), log, state, 15).awaitTermination(120)
    assert committed(spark, log) == 3
    assert sorted(r.seq for r in read_bounded(spark, log).collect()) == list(range(25, 40))
    kept = sorted(p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("generation-"))
    assert kept == ["generation-2", "generation-3"]  # the last one and the one before, for readers under way
    assert all(spark.read.parquet(f"{log}/{g}").count() <= 15 for g in kept)
    spark.createDataFrame([(100, 9)], kind).write.mode("append").parquet(src)
    bounded_log(replayed(spark, src, kind), log, state, 15).awaitTermination(120)
    assert sorted(r.seq for r in read_bounded(spark, log).collect()) == [*range(26, 40), 100]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    src, log, kind = str(tmp_path / "src"), str(tmp_path / "log"), "seq long, ts long"
    spark.createDataFrame([(i, i) for i in range(10)], kind).coalesce(1).write.parquet(src)
    for state in ("one", "two"):  # a new state plays batch 0 again
        bounded_log(replayed(spark, src, kind), log, str(tmp_path / state), 8).awaitTermination(120)
    assert sorted(r.seq for r in read_bounded(spark, log).collect()) == list(range(2, 10))
