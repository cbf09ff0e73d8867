import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siftline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, k string, leaf string, g int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, siblings of each node as (digest or None, whether the node is the right one))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            p.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, i & 1))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for d, source, lang, n, text in rows:
        leaf = h(*map(field, (d, source, lang, n, text)))
        hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        now = h(*map(field, (d, source, lang, n + 1, text))) if hit else leaf
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf, d, now))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        groups[k].sort(key=lambda r: r[:3])
        trees[k] = tree([r[2] for r in groups[k]])
    root, tops = tree([trees[k][0] for k in order])
    out = []
    for k, top in zip(order, tops):
        for (_, _, leaf, d, now), path in zip(groups[k], trees[k][1]):
            acc = now
            for s, right in path + top:
                acc = h(acc) if s is None else h(s, acc) if right else h(acc, s)
            out.append((d, leaf, trees[k][0], root, h(*[s for s, _ in path + top if s]), acc, acc == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, merkle.proof_digests(merkle.documents_manifest(docs)).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 700])
def test_sizes_round_an_array(spark, n):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_and_odd_groups(spark):
    rows = [(i, None, None, None, None) for i in range(5)]
    rows += [(None, "a", "é", 3, "x"), (None, "b", "é", 4, ""), (7, "a", "z", 1, "same"), (7, "a", "z", 1, "same"), (7, "b", "z", 1, "other")]
    rows += [(-5, "a", "", 2147483647, "12:3"), (10**12, "1", "", 0, "long " * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_many_groups_and_more_than_two_layers(spark):
    rows = [(i, "s", f"g{i % 300}" if i % 2 else "hot", i, "t") for i in range(1200)]
    assert run(spark, rows) == brute(rows)


def test_three_layers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(i, "s", "en" if i < 130 else "fr", i, "t") for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_other_fields(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, lang string")
    assert merkle.manifest(docs.limit(0), fields=["id"], group="lang", doc_id="id").collect() == []
    rows = merkle.manifest(docs, fields=["id", "lang"], group="lang", doc_id="id").orderBy("doc_id").collect()
    assert rows[0].leaf == h("1:1", "1:a") and rows[0].root == h(rows[0].leaf, rows[1].leaf) and all(r.verified for r in rows)
    assert rows[1].path == [] and rows[1].top_path == [rows[0].leaf]


def test_a_proof_needs_no_other_row(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("k").alias("lang"))
    one = merkle.manifest(docs, fields=["doc_id"], group="lang").where("doc_id = 13").collect()[0]
    acc = h(field(13))
    for i, s in enumerate(one.path):
        acc = h(acc) if s is None else h(s, acc) if 13 >> i & 1 else h(acc, s)
    assert acc == one.subroot == one.root
