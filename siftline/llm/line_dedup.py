"""Line dedup with compressed keep bitmaps.

Every line's key is hashed to 128 bits.  Occurrences (hash, document, position) are range-partitioned by hash and
document and sorted by hash, document and position, so a partition streams each key's documents in order and a
very common key is cut between documents over several partitions.  What a partition knows of a key (documents,
first occurrence) is one small row; only these rows are added up over partitions.  Lines that go are returned
per document as a compressed bitmap of the lines that stay, instead of as text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import lower_ascii, small, stash

#: What is stripped at both ends of a line to give its key.
STRIP = " \t\n\x0b\x0c\r"


def occurrences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2 (hash of the key), d, h (document), pos, for lines whose key is not empty; repeated rows count once."""
    lines = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("h"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    key = lower_ascii(F.btrim("line", F.lit(STRIP)))
    keyed = lines.select("d", "h", "pos", key.alias("key")).where("key != ''")
    return keyed.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"), "d", "h", "pos")


def _streamed(least: int):
    """A function over sorted partitions: the keys with at least ``least`` documents there, and the first and last.

    All of a key lies in one partition unless it is a partition's first or last key, so what is left out is known
    to be rare.  Rows: key, number of its documents in the partition, its first occurrence there.
    """

    def run(batches):
        held, is_first = None, True  # the key that may go on in the next batch
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            null = np.asarray(batch.column("d").is_null())
            d = batch.column("d").fill_null(0).to_numpy()
            k1, k2, h, pos = (batch.column(c).to_numpy() for c in ("k1", "k2", "h", "pos"))
            same_key, same_doc = np.zeros(n, bool), np.zeros(n, bool)
            same_key[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
            same_doc[1:] = (d[1:] == d[:-1]) & (h[1:] == h[:-1]) & (null[1:] == null[:-1])
            if held:
                same_key[0] = held["k1"] == k1[0] and held["k2"] == k2[0]
                same_doc[0] = held["last"] == (bool(null[0]), d[0], h[0])
            starts = np.flatnonzero(~same_key)
            counts = np.bincount(np.cumsum(~same_key), weights=~(same_key & same_doc), minlength=len(starts) + 1).astype(np.int64)
            rows = []
            if held:
                held["n"] += int(counts[0])
                if len(starts) and (is_first or held["n"] >= least):
                    rows.append(held)
                is_first = is_first and not len(starts)
            for x, (i, c) in enumerate(zip(starts, counts[1:])):
                if x == len(starts) - 1 or c >= least or is_first:
                    row = {"k1": int(k1[i]), "k2": int(k2[i]), "n": int(c), "d": None if null[i] else int(d[i]), "h": int(h[i]), "pos": int(pos[i])}
                    if x == len(starts) - 1:
                        held = row
                    else:
                        rows.append(row)
                        is_first = False
            held["last"] = (bool(null[-1]), d[-1], h[-1])
            if rows:
                yield _rows(rows)
        if held:
            yield _rows([held])

    return run


def _rows(rows):
    kinds = dict(k1=pa.int64(), k2=pa.int64(), n=pa.int64(), d=pa.int64(), h=pa.int64(), pos=pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], list(kinds))


def key_table(found: DataFrame, least: int = 1) -> DataFrame:
    """k1, k2, n (documents that hold the key, if ``least`` or more), first (occurrence: d, h, pos; null ids come first)."""
    ordered = found.repartitionByRange("k1", "k2", "d", "h").sortWithinPartitions("k1", "k2", "d", "h", "pos")
    streamed = ordered.mapInArrow(_streamed(least), "k1 long, k2 long, n long, d long, h long, pos int")
    first = F.min(F.struct(F.col("d").isNotNull().alias("known"), "d", "h", "pos"))
    return streamed.groupBy("k1", "k2").agg(F.sum("n").alias("n"), first.alias("first")).where(F.col("n") >= least)


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 10, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, h, keep for documents that lose lines: ``keep`` is a zlib-compressed bitmap, lowest bit first.

    Lines whose key is in at least ``min_docs`` documents go; with ``keep_first`` the key's first occurrence (by
    document id, then position) stays.  Lines past the bitmap's end stay.
    """
    found = stash(occurrences(docs, doc_id=doc_id, text=text), "lines")
    common = stash(key_table(found, min_docs), "common-lines")
    gone = found.join(small(common, 80), ["k1", "k2"])
    if keep_first:
        gone = gone.where(~(F.col("d").eqNullSafe(F.col("first.d")) & (F.col("h") == F.col("first.h")) & (F.col("pos") == F.col("first.pos"))))

    def pack(batches):
        for batch in batches:
            out = []
            for places in batch.column("gone"):
                p = places.values.to_numpy()
                stay = np.ones(int(p.max()) + 1, bool)
                stay[p] = False
                out.append(zlib.compress(np.packbits(stay, bitorder="little").tobytes() + bytes([-len(stay) % 8])))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), pa.array(out, pa.binary())], ["d", "h", "keep"])

    return gone.groupBy("d", "h").agg(F.collect_list("pos").alias("gone")).mapInArrow(pack, "d long, h long, keep binary")


def stays(keep: bytes | None, n: int) -> np.ndarray:
    """Which of ``n`` lines a bitmap keeps."""
    out = np.ones(n, bool)
    if keep:
        raw = zlib.decompress(keep)
        bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8), bitorder="little")[: 8 * (len(raw) - 1) - raw[-1]].astype(bool)
        out[: len(bits)] = bits[:n]
    return out


def drop_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", texts: bool = False, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256, keep (the bitmap, null: all stay).

    Null and empty texts are one empty line, which always stays.  With ``texts`` the kept lines, joined by
    newlines, come as column ``kept``.  Repeated rows (same id and text) are one document in the counts and each
    get a row.  No documents give no rows.
    """
    maps = keep_bitmaps(docs, doc_id=doc_id, text=text, **options).alias("m")
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t")
    same = F.col("t.d").eqNullSafe(F.col("m.d")) & (F.col("t.h") == F.col("m.h"))

    def apply(batches):
        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for t, keep in zip(batch.column("text"), batch.column("keep").to_pylist()):
                lines = t.as_buffer().to_pybytes().split(b"\n")
                if keep:
                    stay = stays(keep, len(lines))
                    left = b"\n".join(x for x, s in zip(lines, stay) if s)
                    gone.append(int(len(lines) - stay.sum()))
                else:
                    left = t.as_buffer().to_pybytes()
                    gone.append(0)
                n.append(len(lines))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            out = [batch.column("d"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), batch.column("keep")]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary()).cast(pa.string())] * texts, ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep"] + ["kept"] * texts)

    joined = rows.join(maps, same, "left").select("t.d", "t.text", "m.keep")
    return joined.mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep binary" + ", kept string" * texts)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key(line) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), common AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT l.doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.k = c.k
GROUP BY l.doc_id
""".replace("lower_key(line)", "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
