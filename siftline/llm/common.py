"""What the operators of this subpackage share: text rules, the shared scratch folder, size-checked broadcasts."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import scratch as scratch_space
from siftline.broadcasts import small  # noqa: F401  operators of this package take it from here

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Runs between ASCII blanks (space and U+0009 to U+000D).
TOKEN = r"[^\x20\x09-\x0D]+"

def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines of the cluster see (:func:`siftline.scratch.shared_root`).  Also bounds the session's Arrow batches."""
    scratch_space.bounded_batches(spark)
    return scratch_space.shared_root(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is made there yet."""
    shared_root(spark)
    return scratch_space.new_path(spark, name)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it back: cuts lineage and survives lost executors."""
    shared_root(df.sparkSession)
    return scratch_space.stored(df, name)


unstash = scratch_space.dropped


def storage(uri: str):
    """(file system, path) for a worker's own files below the shared folder, whichever store that is."""
    import pyarrow.fs as fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put_file(uri: str, chunks) -> int:
    """Writes a file under a name of this attempt and renames it: a repeated task leaves one whole file."""
    store, path = storage(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(part, path)
    return size


def map_file(uri: str):
    """A buffer over a whole file: memory-mapped where the shared folder is mounted, else read."""
    import pyarrow as pa

    store, path = storage(uri)
    if store.type_name == "local":
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with store.open_input_file(path) as f:
        return f.read_buffer()


def kept(name: str, make):
    """A value made once in each Python process (tokenizers, mapped models), however the caller was shipped."""
    holder = sys.modules.setdefault("_siftline_kept", types.ModuleType("_siftline_kept"))
    values = holder.__dict__.setdefault("values", {})
    if name not in values:
        values[name] = make()
    return values[name]


def trimmed(run):
    """``run`` (of batches) for ``mapInArrow``; a task's freed memory goes back to the system at its end, as its worker lives on."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Returns what Arrow and the C library hold of freed memory, where they can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def ship() -> None:
    """Sends this package's functions by value, so that workers need no copy of it on their path."""
    from pyspark import cloudpickle

    import siftline

    cloudpickle.register_pickle_by_value(siftline)
