"""Vectorised words and word hashes over Arrow text batches (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftline.llm.common import kept

#: Bytes of text that are hashed at once; what is needed beside the text is about 40 times this.
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _tables():
    """Blanks, a random number for each byte with A-Z as a-z, and powers of the base and its inverse."""
    token = np.ones(256, bool)
    token[[0x20, 9, 10, 11, 12, 13]] = False
    value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]
    powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return token, value, powers


def _powers(n: int):
    powers = kept("hash-tables", _tables)[2]
    for i, base in enumerate((BASE, INVERSE)):
        if len(powers[i]) < n:
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            powers[i] = np.multiply.accumulate(grown)
    return powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings (no nulls) and each string's first byte, plus the end."""
    wide = texts.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of other than ASCII blanks, A-Z taken as a-z, and each text's first one, plus the end.

    Texts of any length are hashed in slices that are cut between words.
    """
    token, value, _ = kept("hash-tables", _tables)
    is_token = token[data]
    first = is_token.copy()
    first[1:] &= ~is_token[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = is_token[inner]
    starts = np.flatnonzero(first)
    last = is_token.copy()
    last[:-1] &= ~is_token[1:]
    last[inner - 1] = is_token[inner - 1]
    ends = np.flatnonzero(last) + 1
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        forward, back = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[data[lo:hi]] * forward[: hi - lo], out=sums[1:])
        s = starts[a:b] - lo
        out[a:b] = mixed((sums[ends[a:b] - lo] - sums[s]) * back[s] + (ends[a:b] - starts[a:b]).astype(np.uint64))
        a = b
    return out, np.searchsorted(starts, offsets)


def slices(texts: pa.Array, most: int = 4 << 20):
    """(first row, rows) of parts of an array of strings of about ``most`` bytes each."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        yield a, b - a
        a = b
