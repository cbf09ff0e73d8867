import base64
import collections
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from siftline.llm.warc import LoserTree, archive, map_file, merge_runs, parse, url_key, write_archives


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("https://www.Example.com:443/a?b=1") == "com,example)/a?b=1"
    assert url_key("http://example.com:8080") == "com,example:8080)/"
    assert url_key(None) == ")/" and url_key("http://[bad") == "http://[bad"


def pages():
    rng = random.Random(5)
    rows = [(i, f"http://h{rng.randrange(5)}.org/p{rng.randrange(30)}", rng.choice(["same", "", None, f"<p>é {i}</p>", "x" * 5])) for i in range(150)]
    return rows + [(150, None, "same\r\n\r\nbody"), (151, "http://x.org/a\tb\nc", "tab"), rows[3], (None, "http://n.org/", "null id"), (152, "http://big.org/", "y" * 400_000)]


def frame(spark, rows, parts=7):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as last", "3 as key").repartition(parts)


def brute(rows, least=0):
    last = collections.defaultdict(lambda: None)
    for p, _, h in rows:
        h = (h or "").encode()
        if len(h) >= least and p is not None:
            last[h] = p if last[h] is None else max(p, last[h])
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        refers = last[h] if len(h) >= least and last[h] != p else None
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = pages()
    for least in (0, 3):
        got = archive(frame(spark, rows), least_bytes=least)
        assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(rows, least)


def test_history_is_globally_ordered(spark):
    runs = write_archives(frame(spark, pages(), parts=11))
    for options in ({"ranges": 5}, {"fan_in": 3, "ranges": 4}):
        got = merge_runs(runs, **options).orderBy("part", "position").collect()
        keys = [(r.url_key, r.seconds, -1 if r.page_id is None else r.page_id) for r in got]
        assert len(keys) == len(pages()) and keys == sorted(keys)


def test_archives_read_alone(spark):
    rows = pages()
    out = write_archives(frame(spark, rows)).collect()
    found = []
    for run in out:
        raw = bytes(map_file(run.uri.replace("run-", "pages-") + ".warc.gz"))
        while raw:
            d = zlib.decompressobj(31)
            found.append(parse(d.decompress(raw) + d.flush()))
            raw = d.unused_data
    assert sorted(repr(r["page_id"]) for r in found) == sorted(repr(r[0]) for r in rows)
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r["payload"] == payload[r["page_id"]] for r in found if r["record_type"] == "response")


def test_empty(spark):
    assert archive(frame(spark, [])).collect() == []
