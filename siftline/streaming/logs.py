"""ST5, ST7, K14: trace streams into an append-only table, read back as a bounded newest-first view; test replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.operators.ranking import newest
from siftline.scratch import dropped


def append_log(stream: DataFrame, path: str, checkpoint: str, **options):
    """Starts an append of a stream to a Parquet table; exactly once by the file sink's own log."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def log_view(spark: SparkSession, path: str, n: int = 200, *, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest ``n`` rows of a log."""
    return newest(spark.read.parquet(path), n, ts, seq)


def replayed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, a few in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def bounded_log(stream: DataFrame, path: str, checkpoint: str, limit: int, *, ts: str = "ts", seq: str = "seq", **options):
    """K14, ST5: starts a log of the newest ``limit`` rows; it never holds more after a commit.

    Each micro-batch writes a new generation of the log (the old one and the batch, cut to the limit) beside the old one
    and then commits it: a small file that names it is put in place by a rename.  Generations that no commit names are
    deleted afterwards.  A batch that is repeated after a failure finds its own commit and does nothing, or finds the
    one before and does its work again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = committed(spark, path)
        if now is not None and now >= number:
            return
        rows = batch if now is None else spark.read.parquet(f"{path}/generation-{now}").unionByName(batch)
        newest(rows, limit, ts, seq).write.mode("overwrite").parquet(f"{path}/generation-{number}")
        _commit(spark, path, number)
        for name in _names(spark, path):
            if name.startswith("generation-") and name not in (f"generation-{number}", f"generation-{now}"):
                dropped(spark, f"{path}/{name}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()


def read_bounded(spark: SparkSession, path: str) -> DataFrame:
    """ST7: the rows of the generation that was committed last."""
    return spark.read.parquet(f"{path}/generation-{committed(spark, path)}")


def committed(spark: SparkSession, path: str) -> int | None:
    """The number of the batch that was committed last."""
    found = [int(n.removeprefix("commit-")) for n in _names(spark, path) if n.startswith("commit-")]
    return max(found, default=None)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, store = _files(spark, path)
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def _commit(spark: SparkSession, path: str, number: int) -> None:
    part, store = _files(spark, f"{path}/_commit-{number}")
    store.create(part, True).close()
    store.rename(part, _files(spark, f"{path}/commit-{number}")[0])
    for name in _names(spark, path):
        if name.startswith("commit-") and int(name.removeprefix("commit-")) < number:
            dropped(spark, f"{path}/{name}")
