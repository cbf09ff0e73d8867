"""Labels from an external model, resumable, in Arrow batches.

The caller passes ``call(prompt) -> (text, log probabilities)``.  It is called inside of the executors' batches,
with retries, and its answers are appended to a table before anything is derived from them, so a run that is cut
off goes on where it stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.signals import confidence
from siftline.scratch import stored
from siftline.sources.files import todo

#: Statuses worth another try, and the wait in seconds before the first one, doubled each time.
RETRY_STATUS, FIRST_WAIT = (408, 409, 425, 429, 500, 502, 503, 504), 0.8
ANSWER = "id string, label string, logprobs array<double>, latency_ms bigint, note string"


class CallFailed(Exception):
    """A call that did not answer; ``status`` is the HTTP status, or None if there was no answer at all."""

    def __init__(self, status: int | None):
        super().__init__(f"status {status}")
        self.status = status


def with_retries(call: Callable, prompt: str, tries: int = 3, wait: Callable[[float], None] = time.sleep):
    """The call's answer; failures that may pass are tried again after 0.8, 1.6, … seconds."""
    for n in range(tries):
        try:
            return call(prompt)
        except CallFailed as failed:
            if n == tries - 1 or failed.status is not None and failed.status not in RETRY_STATUS:
                raise
            wait(FIRST_WAIT * 2**n)


def labelled(rows: DataFrame, call: Callable, *, tries: int = 3) -> DataFrame:
    """An answer for every row (id, prompt); a call that fails for good leaves a null label and a note."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for id_, prompt in zip(frame["id"], frame["prompt"]):
                began, label, logprobs, note = time.monotonic(), None, None, None
                try:
                    label, logprobs = with_retries(call, prompt, tries)
                except CallFailed as failed:
                    note = str(failed)
                out.append((id_, label, logprobs, round((time.monotonic() - began) * 1000), note))
            yield pd.DataFrame(out, columns=["id", "label", "logprobs", "latency_ms", "note"])

    return rows.select("id", "prompt").mapInPandas(run, ANSWER)


def resume(rows: DataFrame, call: Callable, cache: str, *, tries: int = 3, every: int = 100_000) -> DataFrame:
    """The answers to all rows, asked only where the cache has none, with ``confidence``.

    About ``every`` answers are committed at a time, so a run that is cut off loses at most those in flight.
    """
    spark = rows.sparkSession
    have = spark.read.schema(ANSWER).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], ANSWER)
    open_rows = stored(todo(rows, have.where("label is not null")))
    chunks = max(1, -(-open_rows.count() // every))
    for i in range(chunks):
        part = open_rows.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == i)
        labelled(part, call, tries=tries).write.mode("append").parquet(cache)
    answers = spark.read.schema(ANSWER).parquet(cache)
    # an id that failed and was asked again has several rows: a label wins over none
    best = answers.groupBy("id").agg(F.max_by(F.struct("label", "logprobs", "latency_ms", "note"), F.struct(F.col("label").isNotNull(), "latency_ms")).alias("a"))
    return rows.join(best, "id", "left").select(*rows.columns, "a.*").withColumn("confidence", confidence(F.coalesce("logprobs", F.array().cast("array<double>"))))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
