"""WARC archives with an external index merge.

Writing: each partition's captures are sorted by URL key and time and written as one archive of gzip members; a
run file lists them in that order, with a sparse table of keys at its end.  Of captures with equal payloads one is
the response and the others are revisit records that refer to it.

Merging: runs are merged k ways by a loser tree.  With more than ``FAN_IN`` runs, groups of them are first merged
to longer runs.  In the last pass key ranges, cut at keys sampled from the runs' tables, are merged side by side;
a task opens each run at its range by the sparse table.  The result is a globally ordered capture history.

Runs and archives lie below the shared folder and are renamed into place when whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import map_file, put_file, scratch, small, stash

FAN_IN, BLOCK, SAMPLES = 64, 256, 64
#: Second 0 of captures that come without a time: 2024-01-01T00:00:00Z.
EPOCH = 1_704_067_200


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, lower case, without scheme, www and default ports."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def stamp(seconds: int) -> str:
    import datetime

    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, seconds: int, payload: bytes, refers_to, digest: str) -> bytes:
    """A response record, or a revisit record that carries the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {''.join(c for c in url if c >= ' ')}",
        f"WARC-Date: {stamp(seconds)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> dict:
    """Headers and block of one record; checks the payload of a response against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    page = lambda x: int(v) if (v := x[len("<urn:page:") : -1]) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("a payload does not match its digest")
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "url": fields["WARC-Target-URI"],
        "date": fields["WARC-Date"],
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers, so each step replays one path of log2(k) matches."""

    DONE = object()

    def __init__(self, sources):
        self.sources = [iter(s) for s in sources]
        self.heads = [next(s, self.DONE) for s in self.sources]
        k = self.k = len(self.sources)
        self.losers = [0] * max(k, 1)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.beats(a, b) else (b, a)
        self.top = winners[1] if k > 1 else 0

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is self.DONE or y is self.DONE:
            return y is self.DONE and (x is not self.DONE or a < b)
        return (x, a) < (y, b)

    def __iter__(self):
        while self.k and self.heads[self.top] is not self.DONE:
            champion = self.top
            yield self.heads[champion]
            self.heads[champion] = next(self.sources[champion], self.DONE)
            node = (champion + self.k) // 2
            while node:
                if self.beats(self.losers[node], champion):
                    self.losers[node], champion = champion, self.losers[node]
                node //= 2
            self.top = champion


class Run:
    """A sorted run: lines ``key TAB time TAB page TAB file TAB offset TAB length``, a sparse table, its offset."""

    def __init__(self, uri: str):
        self.raw = memoryview(map_file(uri))
        at = int(bytes(self.raw[-20:]))
        self.end, (self.keys, self.at) = at, json.loads(bytes(self.raw[at:-20]))
        self.keys = [tuple(k) for k in self.keys]

    def rows(self, low=None, high=None):
        """Rows with low <= key < high, read block by block."""
        first = max(0, bisect_left(self.keys, low) - 1) if low is not None else 0
        last = bisect_right(self.keys, high) if high is not None else len(self.keys)
        ends = [*self.at[1:], self.end]
        for b in range(first, last):
            for line in bytes(self.raw[self.at[b] : ends[b]]).decode().split("\n")[:-1]:
                row = unpacked(line)
                if (low is None or row[:3] >= low) and (high is None or row[:3] < high):
                    yield row


def unpacked(line: str) -> tuple:
    key, seconds, page, uri, offset, length = line.split("\t")
    return key, int(seconds), int(page), uri, int(offset), int(length)


def run_chunks(rows):
    """A run's bytes from its sorted rows."""
    keys, at, size, held = [], [], 0, []
    for i, row in enumerate(rows):
        if i % BLOCK == 0:
            chunk = "".join(held).encode()
            size += len(chunk)
            keys.append(row[:3])
            at.append(size)
            held = []
            yield chunk
        held.append("\t".join(map(str, row)) + "\n")
    chunk = "".join(held).encode()
    yield chunk
    yield json.dumps([keys, at]).encode()
    yield b"%20d" % (size + len(chunk))


def roles(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to`` to ``pages`` (page_id, url, html, seconds): null for responses.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those of the largest page id are responses.
    """
    sha = F.sha1(F.col("html").cast("binary"))
    marked = pages.withColumn("sha", sha)
    long_enough = F.octet_length("html") >= least_bytes
    copies = stash(marked.where(long_enough).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last"), "copies")
    joined = marked.join(small(copies, 96), "sha", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).drop("sha", "last")


def write_archives(pages: DataFrame, *, out: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html and, if there, seconds since 1970) as WARC files; returns their runs.

    One row per run: uri, n and sample (some of its keys).  Null html is an empty payload, a null URL an empty
    one; a null page id is written as none.
    """
    at = out or scratch(pages.sparkSession, "warc")
    seconds = F.col("seconds").cast("long") if "seconds" in pages.columns else EPOCH + F.coalesce(F.col("page_id"), F.lit(0))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), seconds.alias("seconds"))

    def keyed(batches):
        for batch in batches:
            keys = [url_key(u).replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D") for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], [*batch.schema.names, "key"])

    def write(batches):
        name = f"{TaskContext.get().partitionId():06d}"
        warc, index, offset = f"{at}/pages-{name}.warc.gz", [], 0

        def members():
            nonlocal offset
            for batch in batches:
                for row in batch.to_pylist():
                    payload = row["html"].encode()
                    raw = member(record(row["page_id"], row["url"], row["seconds"], payload, row["refers_to"], base32_sha1(payload)))
                    index.append((row["key"], row["seconds"], -1 if row["page_id"] is None else row["page_id"], warc, offset, len(raw)))
                    offset += len(raw)
                    yield raw

        stream = members()
        first = next(stream, None)
        if first is None:
            return
        put_file(warc, (x for part in ([first], stream) for x in part))
        put_file(uri := f"{at}/run-{name}", run_chunks(index))
        keys = [list(map(str, index[i][:3])) for i in range(0, len(index), -(-len(index) // SAMPLES))]
        yield pa.RecordBatch.from_pydict({"uri": [uri], "n": [len(index)], "sample": [keys]})

    done = roles(rows, least_bytes=least_bytes)
    names = "page_id long, url string, html string, seconds long, refers_to long"
    ordered = done.select("page_id", "url", "html", "seconds", "refers_to").mapInArrow(keyed, names + ", key string").sortWithinPartitions("key", "seconds", F.coalesce("page_id", F.lit(-1)))
    return stash(ordered.mapInArrow(write, "uri string, n long, sample array<array<string>>"), "runs")


HISTORY = "part int, position long, url_key string, seconds long, page_id long, uri string, offset long, length long"


def merge_runs(runs: DataFrame, *, ranges: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """The capture history of all runs, globally ordered by part and position."""
    spark, level = runs.sparkSession, 0
    at = scratch(spark, "merged-runs")

    def shorten(_, table):
        group, uris = table.column("group")[0].as_py(), sorted(table.column("uri").to_pylist())
        put_file(uri := f"{at}/run-{table.column('level')[0].as_py()}-{group:06d}", run_chunks(LoserTree([Run(u).rows() for u in uris])))
        keys = [k for s in table.column("sample").to_pylist() for k in s]
        return pa.table({"uri": [uri], "n": [sum(table.column("n").to_pylist())], "sample": [keys[:: -(-len(keys) // SAMPLES)]]})

    while (n := runs.count()) > fan_in:
        groups = -(-n // fan_in)
        dealt = runs.select("uri", "n", "sample", (F.pmod(F.xxhash64("uri"), F.lit(groups))).cast("int").alias("group"), F.lit(level).alias("level"))
        runs, level = stash(dealt.groupBy("group").applyInArrow(shorten, "uri string, n long, sample array<array<string>>"), "runs"), level + 1
    rows = runs.collect()  # at most fan_in
    uris = sorted(r.uri for r in rows)
    keys = sorted((k, int(s), int(p)) for r in rows for k, s, p in r.sample)
    want = ranges or max(1, min(len(keys), spark.sparkContext.defaultParallelism * 2))
    cuts = sorted({keys[len(keys) * i // want] for i in range(1, want)}) if keys else []
    edges = [None, *cuts, None]

    def merge(batches):
        opened = [Run(u) for u in uris]
        for batch in batches:
            for part in batch.column("id").to_pylist():
                merged, held, position = LoserTree([r.rows(edges[part], edges[part + 1]) for r in opened]), [], 0
                for row in merged:
                    held.append((part, position, *row[:2], None if row[2] < 0 else row[2], *row[3:]))
                    position += 1
                    if len(held) == 5000:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    def batch_of(held):
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [x.split()[0] for x in HISTORY.split(", ")])

    return spark.range(0, len(edges) - 1, 1, max(1, len(edges) - 1)).mapInArrow(merge, HISTORY)


def read_records(history: DataFrame) -> DataFrame:
    """Reads each capture's record from its archive, in the history's order, and checks it."""
    names = "part int, position long, url_key string, seconds long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    columns = [x.split()[0] for x in names.split(", ")]

    def read(batches):
        opened: dict[str, memoryview] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["uri"] not in opened:
                    if len(opened) > 256:
                        opened.clear()
                    opened[row["uri"]] = memoryview(map_file(row["uri"]))
                raw = zlib.decompress(opened[row["uri"]][row["offset"] : row["offset"] + row["length"]], 31)
                out.append(row | parse(raw))
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in out], pa.int32() if c == "part" else pa.string() if c in ("url_key", "payload_digest", "record_type") else pa.int64()) for c in columns})

    return history.mapInArrow(read, names)


def archive(pages: DataFrame, *, out: str | None = None, least_bytes: int = 0, **options) -> DataFrame:
    """Writes, merges and reads back: a row per page with page_id, payload_bytes, payload_digest, record_type, refers_to,
    url_key, seconds, part and position (its place in the capture history).

    Repeated rows with the largest page id of their payload are responses each.  Without pages there are no rows.
    """
    return read_records(stash(merge_runs(write_archives(pages, out=out, least_bytes=least_bytes), **options), "history"))


ORACLE = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), groups AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS last,
         list_transform(range(8), lambda g: CAST('0x' || substr(hex, CAST(5 * g + 1 AS INTEGER), 5) AS BIGINT)) AS twenty
  FROM hashed
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       list_aggregate(list_transform(twenty, lambda x: ALPHABET(x >> 15) || ALPHABET(x >> 10) || ALPHABET(x >> 5) || ALPHABET(x)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM groups
"""
for _shift in ("x >> 15", "x >> 10", "x >> 5", "x"):
    ORACLE = ORACLE.replace(f"ALPHABET({_shift})", f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({_shift}) & 31) + 1 AS INTEGER), 1)")
