"""Leakage between a probe set and reference sets: exact matches of normal forms, near matches by shared shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.broadcasts import BROADCAST_BYTES
from siftline.functions.text import overlap_normal
from siftline.operators.setjoin import best_match, similar_across, sketch
from siftline.scratch import stored

#: Cells of a table of probes by shingles that one product takes; references that one product meets.
CELLS, MET = 1 << 22, 256


def normalised(df: DataFrame, *, id_col: str, text: str, compatibility: bool = True) -> DataFrame:
    """id, norm, grams and their bits (X6: short texts, the empty one too, are their own shingle); null texts count as empty."""
    norm = overlap_normal(F.coalesce(F.col(text), F.lit("")), compatibility)
    rows = df.select(F.col(id_col).cast("string").alias("id"), norm.alias("norm"))
    return rows.withColumn("s", sketch(F.col("norm"), own_size=2, empty=True)).select("id", "norm", "s.*")


def exact_matches(probes: DataFrame, references: DataFrame, last_only: bool = False) -> DataFrame:
    """Id, ref for equal normal forms; with ``last_only`` the reference that comes last (``pos``)."""
    refs = references.select(F.col("id").alias("ref"), "norm", *(["pos"] if last_only else []))
    if last_only:
        refs = refs.groupBy("norm").agg(F.max_by("ref", "pos").alias("ref"))
    return probes.select("id", "norm").join(refs, "norm").select("id", "ref")


def near_matches(probes: DataFrame, references: DataFrame, *, threshold: float = 0.78, cap: int | None = 80, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Each probe's best reference and its Jaccard, if that reaches ``threshold``.

    With ``cap`` only the references with the most shared shingles are scored (ties: smaller id).  Ties go to the smaller
    reference.  Probes of up to ``limit`` bytes go to every task and references stay where they are read
    (:func:`met_by_all`); more probes meet them by an exact join of the sets, or with ``cap`` by shingle.
    """
    asked = stored(probes.select("id", "grams"), "asked")
    if asked.agg(F.coalesce(F.sum(8 * F.size("grams") + F.octet_length("id")), F.lit(0))).first()[0] <= limit:
        best = met_by_all(asked, references, threshold, cap)
    elif cap is None:
        one = stored(probes.select(F.col("id").alias("i"), "grams", "bits"), "probes")
        two = stored(references.select(F.col("id").alias("i"), "grams", "bits"), "references")
        return best_match(similar_across(one, two, threshold)).select(F.col("i").alias("id"), F.col("j").alias("ref"), "jaccard")
    else:
        ref = references.select(F.col("id").alias("ref"), F.size("grams").alias("nr"), F.explode("grams").alias("gram"))
        own = asked.select("id", F.size("grams").alias("np"), F.explode("grams").alias("gram"))
        shared = own.join(ref, "gram").groupBy("id", "np", "ref", "nr").agg(F.count("*").alias("shared"))
        best = shared.select("id", "ref", "shared", (F.col("shared") / (F.col("np") + F.col("nr") - F.col("shared"))).alias("jaccard"))
    if cap is not None:
        most = W.partitionBy("id").orderBy(F.desc("shared"), "ref")
        best = best.withColumn("_r", F.row_number().over(most)).where(F.col("_r") <= cap)
    first = best.where(F.col("jaccard") >= threshold).groupBy("id").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "ref")).alias("b"))
    return first.select("id", "b.ref", (-F.col("b.j")).alias("jaccard"))


def met_by_all(probes: DataFrame, references: DataFrame, threshold: float, cap: int | None) -> DataFrame:
    """id, ref, shared, jaccard: what each batch of references holds of every probe's best: its best at ``threshold``, or its ``cap`` most shared.

    Shared shingles of all probes and some references are one product of their tables of zeros and ones, so no pair is
    shuffled; what a batch leaves out is behind enough others of the same batch.  ``probes`` are few (a checked size).
    """
    rows = [(r.id, np.array(r.grams, np.int64)) for r in probes.collect()]  # below the limit of a broadcast
    held = probes.sparkSession.sparkContext.broadcast(probe_tables(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best for tables in held.value for best in batch_best(batch, *tables, threshold, cap)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.float64()))], ["id", "ref", "shared", "jaccard"])

    return references.select("id", "grams").mapInArrow(run, "id string, ref string, shared long, jaccard double")


def probe_tables(rows: list[tuple[str, np.ndarray]]) -> list[tuple]:
    """ids, sizes, shingles in order and the table of zeros and ones (shingles, probes) of probes in groups of up to ``CELLS`` cells."""
    out, group, cells = [], [], 0
    for k, (name, grams) in enumerate(rows):
        group.append((name, grams))
        cells += len(grams)
        if k + 1 == len(rows) or (cells + len(rows[k + 1][1])) * (len(group) + 1) > CELLS:
            known = np.unique(np.concatenate([g for _, g in group]))
            table = np.zeros((len(known), len(group)), np.float32)
            for j, (_, g) in enumerate(group):
                table[np.searchsorted(known, g), j] = 1
            out.append(([n for n, _ in group], np.array([len(g) for _, g in group]), known, table))
            group, cells = [], 0
    return out


def batch_best(batch: pa.RecordBatch, ids: list[str], sizes: np.ndarray, known: np.ndarray, table: np.ndarray, threshold: float, cap: int | None) -> Iterator[tuple]:
    """(probe, reference, shared, jaccard) of a batch of references (id, grams) with one group of probes."""
    names, lists, best, most = batch.column(0).to_pylist(), batch.column(1), [[] for _ in ids], cap or 1
    least = np.full(len(ids), 1.0 if cap is not None else threshold)
    for at in range(0, len(names), MET):
        part = lists.slice(at, MET)
        n = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        grams = part.flatten().to_numpy()
        place = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
        hit = known[place] == grams if len(known) else np.zeros(len(grams), bool)
        x = np.zeros((len(n), len(known)), np.float32)
        x[np.repeat(np.arange(len(n)), n)[hit], place[hit]] = 1
        shared = np.rint(x @ table).astype(np.int64)
        score = shared / np.maximum(sizes + n[:, None] - shared, 1)
        order = shared if cap is not None else score
        for i, j in zip(*np.nonzero((order >= least) & (shared > 0))):
            best[j].append((-order[i, j], names[at + i] is not None, names[at + i] or "", int(shared[i, j]), float(score[i, j])))
        for j, found in enumerate(best):
            if len(found) >= most:
                found.sort()
                del found[most:]
                least[j] = -found[-1][0]
    for name, found in zip(ids, best):
        yield from ((name, f[2] if f[1] else None, *f[3:]) for f in found)


def three_places(x: Column) -> Column:
    """A number with three places as C and Python write it: by its exact value, ties to even; the JVM rounds its shortest digits."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.3f}" for v in values.to_pylist()], pa.string())

    return run(x)


def overlap_report(probes: DataFrame, references: DataFrame, **options) -> DataFrame:
    """K9: kind (EXACT, NEAR), id, ref, score as text with three places; probes with an exact match are not scored again."""
    exact = exact_matches(probes, references).select(F.lit("EXACT").alias("kind"), "id", "ref", F.lit(1.0).alias("score"))
    rest = probes.join(exact.select("id").distinct(), "id", "left_anti")
    near = near_matches(rest, references, **options).select(F.lit("NEAR").alias("kind"), "id", "ref", F.col("jaccard").alias("score"))
    return exact.unionAll(near).withColumn("score", three_places(F.col("score")))


def tagged_union(**sets: DataFrame) -> DataFrame:
    """The rows of several sets with an ``origin`` column."""
    out = None
    for name, df in sets.items():
        tagged = df.withColumn("origin", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def disjoint_ids(new: DataFrame, *known: DataFrame, key: str = "id") -> None:
    """An error if an id of ``new`` is known already."""
    for other in known:
        if clash := new.join(other, key, "left_semi").select(key).limit(3).collect():
            raise ValueError(f"ids known already: {[r[0] for r in clash]}")
