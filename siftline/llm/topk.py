"""Exact top-k search by inner product with a pivot table.

Adding one coordinate that brings every candidate to the same length turns the largest inner product into the
smallest distance.  The distances of all candidates to some pivots are stored beside them; for a query, the
largest difference of its own pivot distances to a candidate's is a lower bound of their distance, and so an
upper bound of their score.  Candidates lie in blocks of neighbours (by nearest pivot), whose bounds are tried
first; inside a block, candidates are evaluated in the order of their bounds, until no bound reaches the k-th
score found.  Bounds carry a margin for rounding and scores are exact integers, so the result is exact.

Queries are broadcast in chunks of a fixed size; each chunk is one pass over the candidates' blocks, and each task
returns its k best for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.common import scratch, stash

PIVOTS, SAMPLE, BLOCK, BATCH = 24, 4096, 4096, 512
#: Bytes of query vectors that are broadcast at once.
CHUNK_BYTES = 16 << 20


def quantised(vectors: DataFrame, scale: int = 256, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v: each component as floor(scale * x); rows with a null id, a null or empty vector or a null or non-finite component are left out."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.transform(e, lambda x: F.floor(scale * x.cast("double"))).alias("v")).distinct()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows far from one another: each next one is the farthest from those chosen."""
    if not len(sample):
        return sample
    chosen, x = [0], sample.astype(np.float64)
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class Space:
    """Pivots of one dimension and distances to them; ``top`` is the largest squared length of a candidate."""

    def __init__(self, sample: np.ndarray, top: int):
        self.top, self.pivots = float(top), spread_out(sample, PIVOTS).astype(np.float64)
        self.extra = np.sqrt(np.maximum(self.top - (self.pivots**2).sum(1), 0))

    def candidate(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        extra = np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.top - 2 * (x @ self.pivots.T + extra[:, None] * self.extra), 0))

    def query(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + self.top - 2 * x @ self.pivots.T, 0))

    def score_bound(self, length: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The largest score that a query of squared length ``length`` can have at a distance of ``gap`` or more."""
        slack = 1e-6 * (length + self.top) + 1
        return (length + self.top - gap**2) / 2 + slack


class Best:
    """The k best (score, then smaller id) of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        q = np.concatenate([q, np.repeat(touched, self.k)])
        ids = np.concatenate([ids, self.id[touched].ravel()])
        scores = np.concatenate([scores, self.score[touched].ravel()])
        order = np.lexsort((ids, -scores.astype(np.float64), q)) if np.abs(scores[scores > np.iinfo(np.int64).min]).max(initial=0) < 2**52 else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(scores[i]), ids[i])))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, touched)
        pick = first[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = scores[pick], ids[pick]


def search_block(space: Space, best: Best, rows: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, near: np.ndarray, ids: np.ndarray, v: np.ndarray, table: np.ndarray) -> None:
    """Brings ``best`` up to date with one block; ``rows`` are the queries of its dimension."""
    length = (queries.astype(np.float64) ** 2).sum(1)
    gap = np.maximum(np.maximum(table.min(0) - near, near - table.max(0)).max(1, initial=0), 0)
    live = np.flatnonzero(space.score_bound(length, gap) >= best.least()[rows])
    for a in range(0, len(live), 128):
        part = live[a : a + 128]
        gaps = np.zeros((len(part), len(ids)))
        for p in range(table.shape[1]):
            np.maximum(gaps, np.abs(near[part, p, None] - table[None, :, p]), out=gaps)
        bound = space.score_bound(length[part, None], gaps)
        order = np.argsort(-bound.max(0), kind="stable")
        for b in range(0, len(order), BATCH):
            some = order[b : b + BATCH]
            open_ = (bound[:, order[b:]].max(1) >= best.least()[rows[part]]).nonzero()[0]
            if not len(open_):
                break
            some = some[(bound[np.ix_(open_, some)] >= best.least()[rows[part[open_]], None]).any(0)]
            scores = product(queries[part[open_]], v[some])
            good = (scores >= best.least()[rows[part[open_]], None]) & (query_ids[part[open_], None] != ids[None, some])
            i, j = good.nonzero()
            best.add(rows[part[open_[i]]], ids[some[j]], scores[i, j])


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, chunk_bytes: int = CHUNK_BYTES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of each row whose id is divisible by ``every``.

    Candidates are all rows of the same dimension with another id; ties go to the smaller id.  Repeated rows (same
    id and vector) count once; with several vectors under one id each is a candidate, and a query id asks with each
    of them.  Rows with null ids, null or empty vectors, null or non-finite components take no part.  Fewer candidates
    than ``k`` give fewer rows, no rows give none.  Scores are exact below 2**52, and whole below 2**63.
    """
    spark = vectors.sparkSession
    rows = stash(quantised(vectors, scale, vec_id=vec_id, embedding=embedding).withColumn("dim", F.size("v")), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    tops = {r[0]: r[1] for r in rows.groupBy("dim").agg(F.max(square)).collect()}
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(r.dim, []).append(r.v)
    spaces = {d: Space(np.array(sample.get(d, []), np.int64).reshape(-1, d), top) for d, top in tops.items()}

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                table = spaces[d].candidate(matrix(part.column("v"), d))
                cell = table.argmin(1) if table.shape[1] else np.zeros(len(table), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), pa.array(cell.astype(np.int32)), part.column("id"), part.column("v"), pa.array([x.tobytes() for x in table], pa.binary())], ["dim", "cell", "id", "v", "table"]
                )

    placed = rows.select("dim", "id", "v").mapInArrow(place, "dim int, cell int, id long, v array<long>, table binary")
    candidates = stash(placed.repartitionByRange("dim", "cell", "id").sortWithinPartitions("dim", "cell", "id"), "candidates")
    chunks, paths = _chunks(rows.where(F.pmod("id", F.lit(every)) == 0), chunk_bytes), []
    for asked in chunks:
        queries = spark.sparkContext.broadcast(asked)

        def search(batches, queries=queries):
            bests, near = {}, {}
            for d, (ids, v) in queries.value.items():
                bests[d], near[d] = Best(len(ids), k), spaces[d].query(v)
            for batch in batches:
                dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
                edges = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (cells[1:] != cells[:-1]), [True]])) if len(dims) else [0]
                for lo, hi in zip(edges[:-1], edges[1:]):
                    d = int(dims[lo])
                    if d not in bests:
                        continue
                    for a in range(lo, hi, BLOCK):
                        part = batch.slice(a, min(BLOCK, hi - a))
                        table = np.frombuffer(b"".join(part.column("table").to_pylist()), np.float64).reshape(part.num_rows, -1)
                        ids, v = queries.value[d]
                        search_block(spaces[d], bests[d], np.arange(len(ids)), v, ids, near[d], part.column("id").to_numpy(), matrix(part.column("v"), d), table)
            for d, best in bests.items():
                q, r = np.nonzero(best.score > np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array(queries.value[d][0][q]), pa.array(best.id[q, r]), pa.array(best.score[q, r])], ["query_id", "vec_id", "score"])

        paths.append(scratch(spark, "best"))
        candidates.mapInArrow(search, "query_id long, vec_id long, score long").write.parquet(paths[-1])
        queries.unpersist()
    if not paths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(*paths)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunks(queries: DataFrame, chunk_bytes: int):
    """The queries in chunks of bounded size: {dim: (ids, vectors)}."""
    dims = {r[0]: r[1] for r in queries.groupBy("dim").count().collect()}
    total = sum((8 * d + 8) * n for d, n in dims.items())
    parts = -(-total // chunk_bytes) if total else 0
    for p in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p) if parts > 1 else queries
        table = mine.select("dim", "id", "v").toArrow()
        of = table.column("dim").to_numpy()
        out = {}
        for d in np.unique(of):
            part = table.filter(pa.array(of == d)).combine_chunks()
            out[int(d)] = (part.column("id").to_numpy(), matrix(part.column("v").combine_chunks() if part.num_rows else pa.array([], pa.int64()), int(d)))
        if out:
            yield out


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
