"""Sorted keys with counts as compact byte strings, so that counts move as a row for each task and shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A row: the shard, its sorted keys (differences, by byte planes) and their counts (by byte planes).
BLOBS = "shard int, keys binary, counts binary"


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


def blobs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """A row (shard, keys, counts) for each shard of sorted keys."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order].astype(np.uint64)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    cut = list(zip(at, [*at[1:], len(shard)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[at], pa.int32()), pa.array([pack(keys[a:b]) for a, b in cut], pa.binary()), pa.array([planes(counts[a:b]) for a, b in cut], pa.binary())],
        ["shard", "keys", "counts"],
    )


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and summed counts of the rows of one shard."""
    keys = [unpack(x) for x in table.column("keys").to_pylist()]
    counts = [unplanes(x, np.uint64) for x in table.column("counts").to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts))
