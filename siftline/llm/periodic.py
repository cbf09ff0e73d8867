"""Periodic runs of words by bit-parallel lags.

A run is a stretch of words with smallest period ``q`` that holds ``repeats`` periods and ``least`` words or more and that
no neighbouring word extends.  Words become numbers; bit ``i`` of plane ``k`` is bit ``k`` of word ``i``'s number, and a
plane is one big integer.  For a lag ``q`` each plane is XORed with itself shifted by ``q``; the OR of these has a one
wherever words ``i`` and ``i + q`` differ.  A run of period ``q`` is a long enough stretch of zeros in it.  Shift-doubling
AND of the zeros leaves exactly the places where such a stretch goes on for the length that is asked: most lags are left
with none after the first plane or two, and the other planes are not looked at.

Lags rise, and a stretch that a run of a period dividing the lag explains is taken out first, so what is left has the
lag as its smallest period: two periods of one stretch that is this long have a common divisor that is one too.

A text of n words takes n / repeats lags of n / 64 machine words: the work on one text grows with the square of its
length (about a second for 170 000 words).  Its memory is a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "array<struct<start:long,length:long,period:long>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    of = dict.fromkeys(words)
    for i, w in enumerate(of):
        of[w] = i
    return np.fromiter(map(of.__getitem__, words), np.int64, len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """Plane k holds bit k of every number, as one integer; there is one plane at least."""
    most = int(ids.max(initial=0)).bit_length() or 1
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(bool), bitorder="little").tobytes(), "little") for k in range(most)]


def long_stretches(ones: int, need: int) -> int:
    """The places from which ``need`` ones or more follow in a row."""
    have = 1
    while have < need and ones:
        step = min(have, need - have)
        ones &= ones >> step
        have += step
    return ones


def spans(ones: int) -> list[tuple[int, int]]:
    """(first, last) of each stretch of ones."""
    raw = np.frombuffer(ones.to_bytes((ones.bit_length() + 15) // 8, "little"), np.uint8)  # the last bit is a zero
    edges = np.flatnonzero(np.diff(np.unpackbits(raw, bitorder="little").astype(np.int8), prepend=0))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def find_runs(ids: np.ndarray, least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period; ``repeats`` is 2 or more."""
    n, found, going = len(ids), [], []
    if n < least:
        return []
    planes = bit_planes(ids)
    for q in range(1, n // repeats + 1):
        need, inside = max(least - q, (repeats - 1) * q), (1 << (n - q)) - 1
        explained = 0
        going = [r for r in going if r[1] >= repeats * q]
        for start, length, period in going:
            if q % period == 0:
                explained |= ((1 << (length - q)) - 1) << start
        differ, left = explained, 0
        for plane in planes:
            differ |= plane ^ (plane >> q)
            left = long_stretches(inside ^ (differ & inside), need)
            if not left:
                break
        if left:
            new = [(a, b - a + need + q, q) for a, b in spans(left)]
            found += new
            going += new
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeats_of(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words some run holds after its first period."""
    out = np.zeros(n, bool)
    for start, length, period in runs:
        out[start + period : start + length] = True
    return out


def periodic_runs(
    docs: DataFrame, *, least: int = 6, repeats: int = 4, doc_id: str = "doc_id", text: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are what stands between ASCII blanks, case kept.  ``collapsed`` is the text of the words that no run repeats,
    joined by one blank.  ``rewrite`` may change a document's words first.  Null, empty and blank texts have no words, no
    runs and an empty ``collapsed``; null and repeated ids and repeated rows each keep their row; other columns are
    ignored; no rows give no rows.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, runs, collapsed = [], [], []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = t.as_buffer().to_pybytes().split()
                if rewrite:
                    words = rewrite(d, words)
                mine = find_runs(numbered(words), least, repeats)
                counts.append(len(words))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in mine])
                if mine:
                    gone = repeats_of(mine, len(words)).tolist()
                    words = [w for w, x in zip(words, gone) if not x]
                collapsed.append(b" ".join(words))
            out = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Rewrites the words of a tenth of the documents, by a checksum of the id, so that they end in a run; a null id is kept as it is."""
    import zlib

    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def report(rows: DataFrame) -> DataFrame:
    """The runs of :func:`periodic_runs` in figures: their number, the run of greatest exponent, digests.

    The greatest exponent is compared exactly; ties go to the smallest start, then the smallest period.  Without runs
    its four columns are null and ``runs_sha256`` is the digest of nothing.
    """
    best = F.expr(f"""
        aggregate(runs, CAST(NULL AS {RUNS[6:-1]}), (m, r) ->
          IF(m IS NULL OR r.length * m.period > m.length * r.period, r, m))""")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return rows.withColumn("m", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("m.start").alias("start"),
        F.col("m.length").alias("length"),
        F.col("m.period").alias("period"),
        F.expr("1000 * m.length div m.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def oracle() -> str:
    """Runs by a join of equal words: islands of neighbouring matches, without those that a smaller period explains."""
    from siftline.llm.checksum import crc32_sql

    return rf"""
WITH src AS (
  SELECT doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0 FROM documents
), parts AS (
  SELECT doc_id, w0, len(w0) AS n, h % 10 = 0 AND len(w0) > 0 AS hit, h // 10 AS g FROM src
), bounds AS (
  SELECT *, CASE WHEN hit THEN g % n END AS a, CASE WHEN hit THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM parts
), texts AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: w0[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT) + 1]) ELSE w0 END AS w FROM bounds
), words AS MATERIALIZED (
  SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM texts
), met AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM met GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM (SELECT words.* FROM words ANTI JOIN gone USING (doc_id, i)) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id
), ahead AS (
  SELECT DISTINCT ON (doc_id) * FROM runs ORDER BY doc_id, CAST(length AS DOUBLE) / period DESC, start, period
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, m.start, m.length, m.period, 1000 * m.length // m.period AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN ahead m USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
