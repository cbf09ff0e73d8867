"""Tables between steps: written below the folder that all machines share, and read back.

This cuts lineage and survives lost executors.  The folder is the session's ``spark.checkpoint.dir``.  Only where that is
unset, in a session on this machine alone (tests), a temporary folder takes its place; the setting itself cannot be
changed in a running session, so the folder is kept here, one for each application.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Rows and bytes of an Arrow batch, where the session sets none: texts are long, and workers hold a batch whole.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        if not spark.conf.get(key, None):
            spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a cluster that names none is an error, as its machines share no other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="siftline-")
        root = _own[context.applicationId]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder at which nothing stands yet."""
    return f"{shared_root(spark)}/siftline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df``, written and read back; ``dropped`` deletes it again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def dropped(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes stored tables (or paths) that nothing will read any more."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(getattr(table, "stored_at", table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
