"""Language-model scoring: an interpolated modified Kneser-Ney model of word pairs, counted in Spark.

The model lies in files below the shared folder, which workers map into memory:

- ``words-<s>``: the sorted 64-bit hashes of the words of shard ``s`` (the hash's top bits), and their counts.
  A word's id is its place in the concatenation of all shards.
- ``pairs-<s>``: the sorted keys (id of the first word, id of the second) of the pairs of shard ``s``, and their
  counts.  A first word of many occurrences is spread over several shards by its second word.
- ``stats-<s>``: for each id of word shard ``s`` the number of its distinct successors seen once, twice, and more
  often, and the number of its distinct predecessors.

Counts move as sorted arrays, one row for each task and shard, not as a row for each pair.  Every task that
writes a file does so under a name of its own and renames it, so a repeated task does no harm.

With discounts D1, D2, D3+ from the counts of counts, c pairs and c(v) occurrences of v:
``p(w|v) = (c(vw) - D(c(vw)) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) p(w)) / c(v)``, and p(w) is the same over the
number of distinct predecessors, interpolated with the uniform distribution over the vocabulary and one unknown
word.  Words after an unknown word are scored with p(w).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import kept, map_file, put_file, scratch, shared_root
from siftline.llm.hashing import flat, slices, tokens

#: Hashes of the sign before the first word (a context only) and of the end of a text (a token).
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Pairs that a shard should hold; a first word of more occurrences is spread over several shards.
SHARD, SPREAD = 1_500_000, 100_000
#: Tokens that a task gathers before it sorts them.
GATHER = 3_000_000


def planes(x: np.ndarray) -> bytes:
    """An array's bytes, all lowest ones first: sorted and differenced numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def pack(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def unpack(raw: bytes, kind=np.uint64) -> np.ndarray:
    return np.cumsum(unplanes(raw, kind), dtype=kind)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts (one each if not given)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def token_stream(batches):
    """For parts of the batches: the batch, first row, rows, token hashes with an end after each text, each text's first."""
    for batch in batches:
        texts = batch.column("text")
        for a, n in slices(texts):
            h, at = tokens(*flat(texts.slice(a, n)))
            at = at + np.arange(n + 1)
            full = np.full(at[-1], END, np.uint64)
            is_end = np.zeros(at[-1], bool)
            is_end[at[1:] - 1] = True
            full[~is_end] = h
            yield batch, a, n, full, at


def blobs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """A row (shard, n, keys, counts) for each shard of sorted keys."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order].astype(np.uint64)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    cut = list(zip(at, [*at[1:], len(shard)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[at], pa.int32()), pa.array([pack(keys[a:b]) for a, b in cut], pa.binary()), pa.array([planes(counts[a:b]) for a, b in cut], pa.binary())],
        ["shard", "keys", "counts"],
    )


BLOBS = "shard int, keys binary, counts binary"


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and summed counts of the rows of one shard."""
    keys = [unpack(x) for x in table.column("keys").to_pylist()]
    counts = [unplanes(x, np.uint64) for x in table.column("counts").to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts))


class Model:
    """The mapped files of a fitted model."""

    def __init__(self, at: str, meta: dict):
        self.at, self.meta = at, meta
        self.bits, self.sizes = meta["bits"], np.array(meta["sizes"], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.sizes)])
        self.edges = (np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(0, np.uint64)
        self.files: dict = {}

    def file(self, kind: str, s: int) -> np.ndarray:
        if (kind, s) not in self.files:
            self.files[kind, s] = np.frombuffer(map_file(f"{self.at}/{kind}-{s:06d}"), np.uint64)
        return self.files[kind, s]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cut = np.concatenate([[0], np.searchsorted(hashes, self.edges), [len(hashes)]])
        for s in np.flatnonzero(np.diff(cut)):
            if n := int(self.sizes[s]):
                own, q = self.file("words", s), hashes[cut[s] : cut[s + 1]]
                at = np.minimum(np.searchsorted(own[:n], q), n - 1)
                hit = own[at] == q
                ids[cut[s] : cut[s + 1]][hit] = at[hit] + self.base[s]
                counts[cut[s] : cut[s + 1]][hit] = own[n + at[hit]].astype(np.int64)
        return ids, counts

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = self.ids(distinct)
        return ids[back], counts[back]

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """Rows n1, n2, n3, predecessors for sorted ids."""
        out = np.zeros((4, len(ids)), np.int64)
        cut = np.searchsorted(ids, self.base)
        for s in np.flatnonzero(np.diff(cut)):
            own, part = self.file("stats", s).reshape(4, -1), slice(cut[s], cut[s + 1])
            out[:, part] = own[:, ids[part] - self.base[s]]
        return out

    def pair_shard(self, v: np.ndarray, w: np.ndarray, v_count: np.ndarray) -> np.ndarray:
        salt = w % (v_count // SPREAD + 1)
        x = (v * 31 + salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(33)) % np.uint64(self.meta["pair_shards"])).astype(np.int32)

    def pairs(self, v: np.ndarray, w: np.ndarray, v_count: np.ndarray) -> np.ndarray:
        """Counts of pairs of known ids."""
        keys, shard, out = (v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64), self.pair_shard(v, w, v_count), np.zeros(len(v), np.int64)
        order = np.lexsort((keys, shard))
        shard, keys = shard[order], keys[order]
        for s in np.unique(shard):
            if n := self.meta["pair_sizes"][s]:
                a, b = np.searchsorted(shard, [s, s + 1])
                own, q = self.file("pairs", s), keys[a:b]
                at = np.minimum(np.searchsorted(own[:n], q), n - 1)
                hit = own[at] == q
                out[order[a:b][hit]] = own[n + at[hit]].astype(np.int64)
        return out


def training(docs: DataFrame) -> DataFrame:
    """Adds ``held_out``: crc32 of the id's text is divisible by 10 (so it is for a null id)."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("d").cast("string"), F.lit("")).cast("binary")) % 10 == 0)


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; kept inside (0, count) where those are few."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 * k for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def fit(train: DataFrame) -> Model:
    """Counts the texts of ``train`` (text, no nulls) and writes the model."""
    spark, at = train.sparkSession, scratch(train.sparkSession, "model")
    bits = max(0, min(14, (train.rdd.getNumPartitions() // 4).bit_length()))

    def count_words(batches):
        held: list[np.ndarray] = []

        def out():
            keys, counts = summed(np.concatenate(held))
            held.clear()
            return blobs((keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32), keys, counts)

        size = 0
        for _, _, n, h, _ in token_stream(batches):
            held += [h, np.full(n, START, np.uint64)]
            if (size := size + len(h)) > GATHER:
                yield out()
                size = 0
        if held:
            yield out()

    def write_words(table):
        keys, counts = merged(table)
        s = table.column("shard")[0].as_py()
        put_file(f"{at}/words-{s:06d}", [keys.tobytes(), counts.tobytes()])
        starts = int(counts[keys == START].sum())
        return pa.table({"s": pa.array([s], pa.int32()), "n": [len(keys)], "total": [int(counts.sum()) - starts], "starts": [starts]})

    done = train.mapInArrow(count_words, BLOBS).groupBy("shard").applyInArrow(write_words, "s int, n long, total long, starts long").collect()
    sizes = [0] * (1 << bits)
    for r in done:
        sizes[r.s] = r.n
    total, starts = sum(r.total for r in done), sum(r.starts for r in done)
    meta = {"bits": bits, "sizes": sizes, "N": total, "V": sum(sizes) - (starts > 0), "pair_shards": max(1, -(-total // SHARD)), "pair_sizes": [], "empty": not total}
    if sum(sizes) >= 1 << 32:
        raise ValueError("a vocabulary of 2**32 words or more needs wider pair keys")
    if meta["empty"]:
        return Model(at, meta)
    words = Model(at, meta)

    def count_pairs(batches):
        model, held, size = kept(f"model {at}", lambda: words), [], 0

        def out():
            keys, counts = summed(np.concatenate(held))
            held.clear()
            v, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            v_count = np.repeat(counts_of(model, v[first]), np.diff([*first, len(v)]))
            return blobs(model.pair_shard(v, w, v_count), keys, counts)

        for _, _, n, h, first in token_stream(batches):
            before = np.empty(len(h), np.uint64)
            before[1:] = h[:-1]
            before[first[:-1]] = START
            ids, _ = model.known(np.concatenate([before, h[-1:]]))
            w = np.append(ids[1:], 0)[: len(h)]
            w[first[1:] - 1] = model.known(np.array([END], np.uint64))[0][0]
            held.append((ids[: len(h)].astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64))
            if (size := size + len(h)) > GATHER:
                yield out()
                size = 0
        if held:
            yield out()

    def write_pairs(table):
        """Writes a pair shard; rows that start with shard -1 - s carry its counts of counts, the others statistics."""
        keys, counts = merged(table)
        s = table.column("shard")[0].as_py()
        put_file(f"{at}/pairs-{s:06d}", [keys.tobytes(), counts.tobytes()])
        v, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = {"shard": [-1 - s], "kind": [0], "keys": [np.array([len(keys), *((counts == k).sum() for k in (1, 2, 3, 4))], np.uint64).tobytes()], "counts": [b""]}
        for kind, ids in ((1, v[counts == 1]), (2, v[counts == 2]), (3, v[counts > 2]), (4, w)):
            ids, n = np.unique(ids, return_counts=True)
            at_shard = np.searchsorted(words.base, ids, "right") - 1
            batch = blobs(at_shard, ids.astype(np.uint64), n)
            for name in ("shard", "keys", "counts"):
                rows[name] += batch.column(name).to_pylist()
            rows["kind"] += [kind] * batch.num_rows
        return pa.table(rows, schema=pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def write_stats(table):
        s = table.column("shard")[0].as_py()
        if s < 0:
            return pa.table({"s": pa.array([s], pa.int32()), "n": [np.frombuffer(table.column("keys")[0].as_py(), np.uint64).astype(np.int64).tolist()]})
        out = np.zeros((4, int(words.sizes[s])), np.uint64)
        for kind, keys, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "counts"))):
            out[kind - 1, unpack(keys).astype(np.int64) - words.base[s]] += unplanes(counts, np.uint64)
        put_file(f"{at}/stats-{s:06d}", [out.tobytes()])
        a = out[3]
        return pa.table({"s": pa.array([s], pa.int32()), "n": [[int(a.sum()), *(int((a == k).sum()) for k in (1, 2, 3, 4)), int((a > 2).sum())]]})

    paired = train.mapInArrow(count_pairs, BLOBS).groupBy("shard").applyInArrow(write_pairs, "shard int, kind int, keys binary, counts binary")
    stats = paired.groupBy("shard").applyInArrow(write_stats, "s int, n array<long>").collect()
    meta["pair_sizes"] = [0] * meta["pair_shards"]
    pair_n, word_n = np.zeros(5, np.int64), np.zeros(6, np.int64)
    for r in stats:
        if r.s < 0:
            meta["pair_sizes"][-1 - r.s] = r.n[0]
            pair_n += r.n
        else:
            word_n += r.n
    d, e = discounts(pair_n[1:].tolist()), discounts(word_n[1:5].tolist())
    meta |= {"D": d, "E": e, "A": int(word_n[0]), "spare": e[0] * int(word_n[1]) + e[1] * int(word_n[2]) + e[2] * int(word_n[5])}
    return Model(at, meta)


def counts_of(model: Model, ids: np.ndarray) -> np.ndarray:
    """Occurrences of sorted distinct ids."""
    out, cut = np.zeros(len(ids), np.int64), np.searchsorted(ids, model.base)
    for s in np.flatnonzero(np.diff(cut)):
        own, n = model.file("words", s), int(model.sizes[s])
        out[cut[s] : cut[s + 1]] = own[n + ids[cut[s] : cut[s + 1]] - model.base[s]].astype(np.int64)
    return out


def token_scores(model: Model, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a stream: its training count, log10 of the base probability and of the model's."""
    m = model.meta
    distinct, back = np.unique(np.append(h, START), return_inverse=True)
    ids, counts = model.ids(distinct)
    base = np.log10((counts + 0.1) / (m["N"] + 0.1 * (m["V"] + 1)))
    w = back[:-1]
    if m["empty"]:
        return counts[w], base[w], np.full(len(h), -np.log10(m["V"] + 1))
    order = np.argsort(ids, kind="stable")
    n1, n2, n3, a = np.zeros((4, len(ids)), np.int64)
    real = order[ids[order] >= 0]
    n1[real], n2[real], n3[real], a[real] = model.stats(ids[real])
    cut = lambda c, d: np.where(c > 2, c - d[2], np.where(c == 2, 2 - d[1], np.where(c == 1, 1 - d[0], 0.0)))
    single = (cut(a, m["E"]) + m["spare"] / (m["V"] + 1)) / m["A"]
    rest = m["D"][0] * n1 + m["D"][1] * n2 + m["D"][2] * n3
    v = np.empty(len(h), np.int64)
    v[1:] = w[:-1]
    v[first[:-1]] = back[-1]
    p = single[w]
    seen = counts[v] > 0
    both = seen & (counts[w] > 0)
    pair = np.zeros(len(h), np.int64)
    pair[both] = model.pairs(ids[v[both]], ids[w[both]], counts[v[both]])
    p[seen] = (cut(pair[seen], m["D"]) + rest[v[seen]] * p[seen]) / counts[v[seen]]
    return counts[w], base[w], np.log10(p)


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are taken as empty: one token, the end.  A row whose id's crc32 is divisible by 10 is held out of
    the counts, and so is a null id.  If nothing is left to train on, the model is uniform.  No rows give none.
    """
    shared_root(docs.sparkSession)
    rows = training(docs.select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("text")))
    model = fit(rows.where("not held_out").select("text"))
    at, total = model.at, model.meta["N"]

    def run(batches):
        own = kept(f"scored {at}", lambda: model)
        for batch, a, n, h, first in token_stream(batches):
            c, base, p = token_scores(own, h, first)
            known = np.add.reduceat((c > 0).astype(np.int64), first[:-1])
            part = batch.slice(a, n)
            yield pa.RecordBatch.from_arrays(
                [part.column("d"), part.column("held_out"), pa.array(np.diff(first)), pa.array(known), pa.array(np.full(n, total, np.int64)), pa.array(np.add.reduceat(base, first[:-1])), pa.array(np.add.reduceat(p, first[:-1]))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = dict(rows.dtypes)["d"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
