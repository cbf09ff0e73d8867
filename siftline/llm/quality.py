"""Quality classifier by importance resampling.

Two generative models are bags of hashed n-grams, whole words and pairs of neighbouring words: the target model from
labelled good documents, the raw model from all documents.  Each is the share of every bucket among all n-grams
that the model has seen, with one pseudo-count a bucket; an n-gram that a document has c times counts c ** 0.7,
and the counts of a document that come to more than ``LONG`` are scaled to it, so that one long or repetitive document
does not make a model.

A document's log weight is the sum over its n-grams of the log ratio of the two models, taken for a text of
``LENGTH`` n-grams so that length alone is neither merit nor fault.  A bucket whose count in the target model is within
chance of what the raw model expects has ratio 1: an n-gram that the labelled documents had no fair chance to show is
no evidence.  The sample is drawn without replacement by Gumbel top-k: every document's log weight plus Gumbel noise
(hashed from its id and text), of which the k largest are kept.

``k`` is the number of all documents whose log weight reaches a cut that is fitted on labelled rows that the target
model has not seen: half of the good ones, by a hash of the id, make the target model, and the others and the bad ones
the cut.  Labelled rows are a bounded sample of ``LABELLED`` rows at most; counts, weights, k and the k-th key are over
all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siftline.llm.common import stash, trimmed
from siftline.llm.hashing import flat, mixed, slices, tokens

#: At most so many labelled rows take part in the fit, those of the smallest hashed ids.
LABELLED = 500_000
#: Buckets of words and of pairs, and parts in which counts move.
WORDS, PAIRS, PARTS = 1 << 18, 1 << 18, 32
SIZE = WORDS + PAIRS
#: Pseudo-count of a bucket; standard deviations below which a ratio counts as 1; n-grams for which a weight stands.
PRIOR, CHANCE, LENGTH = 1.0, 3.0, 1000
#: Power of the count that an n-gram has in a document, and what a document's counts come to at most.
DAMP, LONG = 0.7, 4000.0
#: Parts of a count that are told apart: counts are whole numbers of them, so sums in any order agree.
UNITS = 1 << 16
#: Bytes of text whose n-grams are held at once; what is needed beside them is about 100 times this.
AT_ONCE = 1 << 18


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, each one's text, and the number of words of each text."""
    h, at = tokens(*flat(texts))
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    beside = doc[1:] == doc[:-1]
    word = (h & np.uint64(WORDS - 1)).astype(np.int64)
    pair = WORDS + (mixed(h[:-1] * np.uint64(3) + h[1:])[beside] & np.uint64(PAIRS - 1)).astype(np.int64)
    return np.concatenate([word, pair]), np.concatenate([doc, doc[1:][beside]]), n


def damped(bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sums over documents of each bucket's count to the power ``DAMP``, scaled where a document has over ``LONG``; in ``UNITS``."""
    keys, counts = np.unique(doc * SIZE + bucket, return_counts=True)
    weights, of = counts**DAMP, keys // SIZE
    scale = np.minimum(1, LONG / np.maximum(np.bincount(of, weights=weights), 1))
    return np.bincount(keys % SIZE, weights=np.rint(weights * scale[of] * UNITS), minlength=SIZE).astype(np.int64)


def _count(batches):
    """Counts of a whole partition: one row for each kind (raw, target) and part of the vector."""
    total = np.zeros((2, SIZE), np.int64)
    for batch in batches:
        texts, good = batch.column("text"), batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        for a, n in slices(texts, AT_ONCE):
            bucket, doc, _ = features(texts.slice(a, n))
            total[0] += damped(bucket, doc)
            if (chosen := good[a : a + n]).any():
                total[1] += damped(bucket[chosen[doc]], doc[chosen[doc]])
    parts = total.reshape(2 * PARTS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(2 * PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "counts"])


def _add(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            x = np.frombuffer(counts, np.int64)
            sums[part] = sums[part] + x if part in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the target model to the raw one for each bucket, 0 where it is within chance."""
    if not target.any():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    p, q = (target + PRIOR) / (target + PRIOR).sum(), (raw + PRIOR) / (raw + PRIOR).sum()
    return np.where(np.abs(target - expected) > CHANCE * np.sqrt(expected + 1), np.log(p / q), 0.0)


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> tuple[np.ndarray, DataFrame]:
    """The log ratios and the labelled sample (doc_id, good, fits: is in the target model); ``docs`` are doc_id, text."""
    ranked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min((F.coalesce(F.col("quality") == 1, F.lit(False)) & F.coalesce(F.col("toxic") == 0, F.lit(False))).cast("int")).alias("good"))
    some = ranked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = stash(some.withColumn("fits", ((F.col("good") == 1) & (F.pmod(F.xxhash64("doc_id", F.lit("fits")), F.lit(2)) == 0)).cast("int")), "labels")
    fits = F.broadcast(sample.where("fits = 1").select("doc_id", F.lit(1).alias("good")))  # bounded by ``limit`` rows of 12 bytes
    marked = docs.join(fits, "doc_id", "left").select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("good", F.lit(0)).alias("good"))
    summed = marked.mapInArrow(trimmed(_count), "part int, counts binary").repartition(2 * PARTS, "part").mapInArrow(_add, "part int, counts binary")
    total = np.zeros((2 * PARTS, SIZE // PARTS), np.int64)
    for row in summed.collect():  # 8 MB, whatever the input
        total[row.part] += np.frombuffer(row.counts, np.int64)
    return log_ratio(*total.reshape(2, -1) / UNITS), sample


def weighed(texts: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of words and the log weight (null without words) of each text (no nulls); a text's do not depend on the others."""
    counts, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, n in slices(texts, AT_ONCE):
        bucket, doc, words = features(texts.slice(a, n))
        counts.append(words)
        weights.append(LENGTH * np.bincount(doc, weights=ratio[bucket], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1))
    count = np.concatenate(counts)
    return count, pa.array(np.concatenate(weights), mask=count == 0)


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, h (hash of the text), n_words, log_weight (null without words)."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)  # 4 MB

    def score(batches):
        for batch in batches:
            count, weight = weighed(batch.column("text"), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(count, pa.int64()), weight], ["doc_id", "h", "n_words", "log_weight"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(trimmed(score), "doc_id long, h long, n_words long, log_weight double")


def with_weights(docs: DataFrame, ratio: np.ndarray, name: str) -> DataFrame:
    """The rows of ``docs`` with their log weights as a last column, as :func:`log_weights` gives them."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches):
        for batch in batches:
            weight = weighed(pc.fill_null(batch.column("text"), ""), held.value)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, weight], [*batch.schema.names, name])

    return docs.mapInArrow(trimmed(score), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest labelled rows on the wrong side; of equals the middle of the widest gap."""
    if not len(scores):
        return 0.0
    if good.all() or not good.any():
        return float(scores.min() if good.all() else np.nextafter(scores.max(), np.inf))
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    wrong = np.concatenate([[0], np.cumsum(g)]) + (len(g) - g.sum()) - np.concatenate([[0], np.cumsum(~g)])
    edge = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    gap = np.diff(edge)
    wrong = np.where(gap > 0, wrong, len(g) + 1)
    i = int(np.lexsort((-gap, wrong))[0])
    return float((edge[i] + edge[i + 1]) / 2)


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096, few: int = 4096) -> float | None:
    """The k-th largest value of a column without sorting it: counts of ever finer bins, a few values at the end."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None or k < 1:
        return None
    while True:
        inside = df.where(F.col(key).between(lo, hi))
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo or inside.limit(few + 1).count() <= few:
            rows = [r[0] for r in inside.select(key).distinct().orderBy(F.desc(key)).limit(few + 1).collect()]
            counts = {r[0]: r[1] for r in inside.where(F.col(key).isin(rows)).groupBy(key).count().collect()} if len(rows) <= few else {}
            for x in rows:
                k -= counts.get(x, 0)
                if k <= 0:
                    return x
            return lo
        hist = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col(key) - lo) / width)).alias("b")).agg(F.count("*"), F.min(key), F.max(key)).collect()}
        for b in sorted(hist, reverse=True):
            if k <= hist[b][0]:
                _, lo, hi = hist[b]
                break
            k -= hist[b][0]
        else:
            return lo


def gumbel_key(weight: str, doc_id: str | Column, h: str | Column, seed: int) -> Column:
    """A log weight plus the noise of a row's id and hash of the text."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, h), 11) + 0.5) / float(1 << 53)
    return F.col(weight) - F.log(-F.log(u))


def drawn(docs: DataFrame, labels: DataFrame, limit: int, seed: int) -> tuple[np.ndarray, DataFrame, float | None]:
    """The log ratios, all rows' log weights and keys, and the smallest key that is selected (None: none is)."""
    ratio, sample = fit(docs.select("doc_id", "text"), labels, limit)
    scored = stash(log_weights(docs, ratio), "weights")
    fair = scored.where("log_weight is not null").join(F.broadcast(sample.where("fits = 0")), "doc_id")
    once = fair.groupBy("doc_id", "h").agg(F.min("log_weight").alias("log_weight"), F.min("good").alias("good"))
    seen = once.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h").limit(2 * limit).select("log_weight", "good").toPandas()
    cut = best_cut(seen["log_weight"].to_numpy(float), seen["good"].to_numpy(bool)) if ratio.any() and seen["good"].any() else -np.inf
    keyed = scored.withColumn("gumbel_key", gumbel_key("log_weight", "doc_id", "h", seed))
    k = scored.where(F.col("log_weight") >= F.lit(float(cut))).count()
    return ratio, keyed, kth_largest(keyed, "gumbel_key", k)


def classify(docs: DataFrame, labels: DataFrame, *, limit: int = LABELLED, seed: int = 17) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, log_weight, gumbel_key, selected, h.

    ``selected`` marks the k largest keys; rows whose key equals the k-th are all selected, so repeated rows
    share their fate.  Texts without words (null, empty, blank) have no weight and are never selected.  Labels
    with null ids are ignored, other nulls count as not good, and an id labelled twice is good only if both say
    so.  Without labelled good rows on both sides of the split every document with words is selected.
    """
    _, keyed, least = drawn(docs, labels, limit, seed)
    selected = F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)
    return keyed.withColumn("selected", selected)


def keep_good(docs: DataFrame, labels: DataFrame, *, limit: int = LABELLED, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` selects, with all their columns.

    Their weights are taken a second time where the rows are read, so no text moves.
    """
    ratio, _, least = drawn(docs, labels, limit, seed)
    if least is None:
        return docs.where("false")
    key = gumbel_key("_log_weight", F.col("doc_id").cast("long"), F.xxhash64("text"), seed)
    return with_weights(docs, ratio, "_log_weight").where(key >= F.lit(least)).drop("_log_weight")
