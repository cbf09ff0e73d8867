"""Token-id output as directly addressable codes.

Ids are split into 8-bit chunks.  Level 0 holds the lowest chunk of every id and a bitmap that says which ids go
on; level 1 holds the next chunk of just those, and so on.  A rank directory gives the number of ones before
every 512 bits, so the chunk that continues id ``i`` lies at ``rank(i)``: any id is read with one look at each
level and without decoding its neighbours.

A file holds whole documents in ascending id order:

    8 bytes magic, 8 bytes length of the header, header (JSON: n_docs, n_tokens, levels, and offset and length of
    each array), then the arrays, each at a multiple of 8 bytes: doc ids (int64), which ids are null (bytes), first token of
    each document and the end (uint64), and for each level: chunks (uint8), bitmap (lowest bit first) and rank
    directory (uint64).

Files are named by partition and number, in order.  They lie below the shared folder or where the caller says,
and are renamed into place when whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import kept, map_file, put_file, scratch, stash, trimmed
from siftline.llm.hashing import flat, slices

MAGIC = b"DACIDS01"
#: Bits between entries of a rank directory; tokens after which a file is closed.
RANK, FILE_TOKENS = 512, 4_000_000
#: Places of a worker's table of pieces (about 45 bytes each), bytes of a piece that it can hold, ids of a piece, and how
#: often a place that is in use turns others away before one takes it.
PLACES, PIECE_BYTES, PIECE_IDS, WORTH = 1 << 20, 16, 6, 3
#: Pieces that are looked up at once, and new pieces that go through the tokenizer in one string, with line ends between.
AT_ONCE, JOINED = 1 << 18, 256
#: Bytes of text that are encoded at once.
TEXT_AT_ONCE = 1 << 18
#: The special token: texts that hold it go whole.
SPECIAL = "<|endoftext|>"
#: First bytes of blanks beyond ASCII (they join runs of blanks) and of the special token, and what a text that goes whole
#: holds, as UTF-8.
LEADS = np.zeros(256, bool)
LEADS[[0x00, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
WIDE = re.compile(rb"\x00|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|" + re.escape(SPECIAL.encode()))
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def splits(path: str) -> bool:
    """Whether a tokenizer's file is a byte-level BPE that encodes pieces one by one.

    The pieces of :func:`cuts` are meant.  That takes the usual splitting pattern without a prefix space, no normaliser, no options that cross or drop
    pieces, and ``SPECIAL`` as the only added token.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    whole = model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    return bool(plain and whole and not spec.get("normalizer") and all(x.get("content") == SPECIAL for x in spec.get("added_tokens") or []))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: at each text, and at each blank that follows another character.

    A piece is a run of ASCII blanks with what follows up to the next one.  No token of a byte-level BPE with the usual
    splitting pattern reaches over such a place, but for blanks beyond ASCII and the special token; a text that holds one
    of those, or a zero byte, is one piece.
    """
    blank = BLANK[data]
    first = np.zeros(len(data), bool)
    first[1:] = blank[1:] & ~blank[:-1]
    lead = np.flatnonzero(LEADS[data])
    raw = memoryview(data)
    for t in np.unique(np.searchsorted(offsets, lead, "right") - 1):
        a, b = int(offsets[t]), int(offsets[t + 1])
        if WIDE.search(raw, a, b):
            first[a:b] = False
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


class Pieces:
    """Encodes texts by their pieces; what a table of pieces holds is looked up, the rest goes through the tokenizer.

    The table has a fixed number of places.  A piece of ``PIECE_BYTES`` or fewer bytes is two numbers, which are its bytes,
    so equal numbers are equal pieces; its place is a hash of them.  A new piece takes its place unless one that was met
    lately is there.  A tokenizer of another kind than :func:`splits` gets whole texts.
    """

    def __init__(self, path: str, places: int = PLACES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.splits = Tokenizer.from_file(path), splits(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.shift = np.uint64(64 - (places - 1).bit_length())
        self.low, self.high = np.zeros(places, np.uint64), np.zeros(places, np.uint64)
        self.size, self.worth, self.ids = np.zeros(places, np.uint8), np.zeros(places, np.uint8), np.zeros((places, PIECE_IDS), np.uint32)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has).

        A piece without blanks but one before its first character may stand between line ends in a longer string:
        the splitting pattern takes each line end by itself there, so the ids between two of them are the piece's.
        """
        out: list = [None] * len(new)
        plain = [self.line is not None and p.isprintable() and p.find(" ", 1) < 0 and SPECIAL not in p for p in new]
        alone, joined = [i for i, x in enumerate(plain) if not x], [i for i, x in enumerate(plain) if x]
        groups = [joined[a : a + JOINED] for a in range(0, len(joined), JOINED)]
        for a in range(0, len(groups), 100):
            texts = ["\n".join([new[i] for i in g]) for g in groups[a : a + 100]]
            for g, e in zip(groups[a:], self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(ids == self.line)
                if len(ends) != len(g) - 1:
                    alone += g
                    continue
                for i, x, y in zip(g, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)]):
                    out[i] = ids[x:y]
        for a in range(0, len(alone), 20_000):
            for i, e in zip(alone[a:], self.tokenizer.encode_batch_fast([new[i] for i in alone[a : a + 20_000]], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def _segment(self, words: np.ndarray, raw: memoryview, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has) of some pieces in a row; ``words`` are the eight bytes from every place on."""
        n = ends - starts
        low = words[starts] & MASKS[np.minimum(n, 8)]
        high = words[np.minimum(starts + 8, len(words) - 1)] & MASKS[np.clip(n - 8, 0, 8)]
        hashed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93))
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0x9FB21C651E98DF25)
        place = (hashed >> self.shift).astype(np.int64)
        fits = n <= PIECE_BYTES
        known = fits & (self.size[place] > 0) & (self.low[place] == low) & (self.high[place] == high)
        self.worth[place[known]] = WORTH
        counts = np.where(known, self.size[place], 0).astype(np.int64)

        missing = np.flatnonzero(~known)
        kinds, rep, of = np.unique(np.where(fits, hashed, starts.astype(np.uint64))[missing], return_index=True, return_inverse=True)
        rep = missing[rep]
        same = (low[rep[of]] == low[missing]) & (high[rep[of]] == high[missing]) & (n[rep[of]] == n[missing]) & (fits[missing] | (rep[of] == missing))
        if not same.all():  # two pieces of one hash: each for itself
            odd = np.flatnonzero(~same)
            of[odd] = len(rep) + np.arange(len(odd))
            rep = np.concatenate([rep, missing[odd]])
        ids, sizes = self._learn([bytes(raw[a:b]).decode() for a, b in zip(starts[rep].tolist(), ends[rep].tolist())])
        first = np.cumsum(sizes) - sizes
        counts[missing] = sizes[of]

        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[spread(at[known], counts[known])] = self.ids.ravel()[spread(place[known] * PIECE_IDS, counts[known])]
        out[spread(at[missing], counts[missing])] = ids[spread(first[of], counts[missing])]
        self._keep(np.flatnonzero(fits[rep] & (sizes > 0) & (sizes <= PIECE_IDS)), rep, place, low, high, ids, first, sizes)
        return out, counts

    def _keep(self, new, rep, place, low, high, ids, first, sizes) -> None:
        where = place[rep[new]]
        taken = self.worth[where] > 0
        self.worth[np.unique(where[taken])] -= 1
        where, at = np.unique(where[~taken], return_index=True)
        new = new[~taken][at]
        self.low[where], self.high[where], self.size[where] = low[rep[new]], high[rep[new]], sizes[new]
        self.ids.ravel()[spread(where * PIECE_IDS, sizes[new])] = ids[spread(first[new], sizes[new])]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (no nulls)."""
        if not self.splits:
            return [np.array(e.ids, np.uint32) for t in texts.to_pylist() for e in self.tokenizer.encode_batch_fast([t], add_special_tokens=False)]
        data, offsets = flat(texts)
        starts = cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words, raw = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,)), memoryview(padded)
        parts = [self._segment(words, raw, starts[a : a + AT_ONCE], ends[a : a + AT_ONCE]) for a in range(0, len(starts), AT_ONCE)]
        ids = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], np.cumsum(np.concatenate([x for _, x in parts]))]) if parts else np.zeros(1, np.int64)
        cut = upto[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``n`` of them, one list after another."""
    upto = np.cumsum(n)
    return np.repeat(first - (upto - n), n) + np.arange(int(upto[-1]) if len(n) else 0)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level."""
    levels = []
    while True:
        more = ids > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(bitmap), np.arange(0, len(bitmap), RANK // 8)) if len(bitmap) else np.zeros(0)
        levels.append(((ids & 0xFF).astype(np.uint8), bitmap, np.concatenate([[0], np.cumsum(ones.astype(np.uint64))]).astype(np.uint64)))
        if not more.any():
            return levels
        ids = ids[more] >> 8


def file_chunks(doc_ids: list[int | None], ids: list[np.ndarray]):
    """The bytes of a file."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.uint64)
    arrays = [np.array([x or 0 for x in doc_ids], np.int64), np.array([x is None for x in doc_ids], np.uint8), first]
    levels = encode_levels(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    arrays += [x for level in levels for x in level]
    spans, at = [], 0
    for x in arrays:
        spans.append([at, x.nbytes])
        at += x.nbytes + -x.nbytes % 8
    header = json.dumps({"n_docs": len(doc_ids), "n_tokens": int(first[-1]), "levels": len(levels), "spans": spans}).encode()
    header += b" " * (-len(header) % 8)
    yield MAGIC + len(header).to_bytes(8, "little") + header
    for x in arrays:
        yield x.tobytes() + bytes(-x.nbytes % 8)


class TokenFile:
    """A file of token ids, mapped into memory."""

    def __init__(self, uri: str):
        raw = np.frombuffer(map_file(uri), np.uint8)
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"{uri} is no token file")
        at = 16 + int.from_bytes(raw[8:16].tobytes(), "little")
        self.head = json.loads(raw[16:at].tobytes())
        parts = [raw[at + a : at + a + n] for a, n in self.head["spans"]]
        self.doc_ids, self.null, self.first = parts[0].view(np.int64), parts[1], parts[2].view(np.uint64).astype(np.int64)
        self.levels = [(parts[i], parts[i + 1], parts[i + 2].view(np.uint64)) for i in range(3, len(parts), 3)]

    def __len__(self) -> int:
        return self.head["n_tokens"]

    def __getitem__(self, i: int) -> int:
        """Id number ``i``, by direct access."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                return value
            block = i // RANK
            before = bitmap[block * RANK // 8 : byte]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bitmap[byte] & ((1 << bit) - 1)).bit_count()
            shift += 8
        raise ValueError("a bitmap goes on below the last level")

    def ids(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            below, out = out, chunks.astype(np.uint32)
            if len(below):
                out[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)] |= below << 8
        return out


def write_tokens(docs: DataFrame, *, tokenizer: str, out: str | None = None, end: int | None = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the token ids of ``docs`` (doc_id, text) in ascending id order; returns the manifest.

    The manifest has a row per file: uri, part, number, n_docs, n_tokens, start (of its first token among all).
    ``tokenizer`` is the path of a file of the tokenizers library, ``end`` an id put after each document (None:
    nothing).  Null texts count as empty; null ids come first; rows that share an id are ordered by a hash of the
    text.  Without documents there are no files.
    """
    at = out or scratch(docs.sparkSession, "tokens")

    def run(batches):
        pieces, part, number = kept(f"pieces {tokenizer}", lambda: Pieces(tokenizer)), TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0

        def close():
            uri = f"{at}/ids-{part:06d}-{number:05d}.dac"
            put_file(uri, file_chunks(doc_ids, ids))
            return pa.RecordBatch.from_pydict({"uri": [uri], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": [len(doc_ids)], "n_tokens": [size]})

        last = np.array([] if end is None else [end], np.uint32)
        for batch in batches:
            for a, n in slices(batch.column("text"), TEXT_AT_ONCE):
                rows = batch.slice(a, n)
                for d, x in zip(rows.column("d").to_pylist(), pieces.encode(rows.column("text"))):
                    doc_ids.append(d)
                    ids.append(np.concatenate([x, last]))
                    size += len(ids[-1])
                    if size >= file_tokens:
                        yield close()
                        doc_ids, ids, size, number = [], [], 0, number + 1
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("d", "h").sortWithinPartitions("d", "h").select("d", "text")
    manifest = stash(ordered.mapInArrow(trimmed(run), "uri string, part int, number int, n_docs long, n_tokens long"), "manifest")
    return manifest.withColumn("start", F.sum("n_tokens").over(W.orderBy("part", "number")) - F.col("n_tokens"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """What the files of a manifest hold, a row per document: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                f = TokenFile(uri)
                ids, n, null = f.ids(), len(f.doc_ids), f.null.view(bool)
                for a in range(0, n, 1000):
                    b = min(n, a + 1000)
                    cut = f.first[a : b + 1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(f.doc_ids[a:b], mask=null[a:b]),
                            pa.array(cut[:-1] + start),
                            pa.array(np.diff(cut)),
                            pa.array([zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cut[:-1], cut[1:])], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = manifest.select("uri", "start").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "uri")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, *, tokenizer: str, **options) -> DataFrame:
    """Writes token files and reads them back: doc_id, start, n_tokens, ids_crc32, a row per row of ``docs``."""
    manifest = stash(write_tokens(docs, tokenizer=tokenizer, **options), "placed-manifest")
    return read_tokens(manifest)
