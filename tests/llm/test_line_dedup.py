import collections
import hashlib
import random

from siftline.llm.line_dedup import drop_lines, keep_bitmaps, key_table, occurrences, stays

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def corpus():
    rng = random.Random(6)
    lines = [f"line {i}" for i in range(40)] + ["", "  ", "Éa", "éa", " x"]
    rows = [(None, None), (-1, ""), (-2, "\n"), (-3, "\n\nline 1\n")]
    for i in range(120):
        some = [rng.choice([str.upper, str, lambda s: f"\t{s} "])(x) for x in rng.choices(lines, weights=[1 / (k + 1) for k in range(45)], k=rng.randrange(12))]
        rows.append((i, "\n".join(some + [f"own {i}"])))
    return rows + [rows[9], (5, "line 0\nunder a used id"), (400, "again\n" * 30_000 + "line 0")]


def brute(rows, least, first=False):
    docs = collections.defaultdict(set)
    place = {}
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            docs[key(x)].add((d, t))
            at = (d is not None, d, None, i) if d is None else (True, d, 0, i)
            place.setdefault(key(x), []).append((at, (d, t, i)))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for i, x in enumerate(lines) if not key(x) or len(docs[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as k1", "3 as keep").repartition(parts)


def test_matches_brute_force(spark):
    rows = corpus()
    for least in (1, 2, 10):
        got = sorted((tuple(r) for r in drop_lines(frame(spark, rows), min_docs=least).drop("keep").collect()), key=repr)
        assert got == brute(rows, least)


def test_counts_over_partitions(spark):
    rows = corpus()
    want = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                want[key(x)].add((d, t))
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            for least in (1, 10):
                got = sorted(r.n for r in key_table(occurrences(frame(spark, rows)), least).collect())
                assert got == sorted(len(v) for v in want.values() if len(v) >= least)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "3")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_first_occurrence_stays(spark):
    rows = [(3, "a\nb\na"), (1, "A\nc"), (2, "b\nc\nd"), (4, "d")]
    out = {r.doc_id: r for r in drop_lines(frame(spark, rows), min_docs=1, keep_first=True, texts=True).collect()}
    assert {d: r.kept for d, r in out.items()} == {1: "A\nc", 2: "b\nd", 3: "", 4: ""}
    maps = {r.d: r.keep for r in keep_bitmaps(frame(spark, rows), min_docs=1, keep_first=True).collect()}
    assert stays(maps[2], 3).tolist() == [True, False, True] and 1 not in maps


def test_empty(spark):
    assert drop_lines(frame(spark, [])).collect() == []
