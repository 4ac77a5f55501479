"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors are integers, floor(SCALE * x). The index of a block of vectors holds its components as posting segments by
quantised impact: segment b has the (vector, dimension, impact) with 4^(b-1) <= |impact| < 4^b. A batch of queries takes
the segments from the largest impacts down and adds their contributions to its accumulators. After each segment, what a
vector can still gain or lose is at most |query| * |rest of the vector|; a vector whose upper bound is below the k-th
best lower bound can't be a member. Segments end when the possible members are few, or none are left; then the
possible members are rescored exactly. A block's index is built once, and all queries stream past it; neither side is
ever whole in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, tidy

SCALE, K, EVERY = 256, 5, 50
#: Components of one index block; queries that are scored at once, and their scores.
BLOCK, BATCH, SCORES = 1 << 19, 256, 1 << 21
#: Segments end when a batch's possible members are this share of its block, or less.
FEW = 1 / 64
#: A segment is added posting by posting if it fills this share of its rows or less, else row by row.
SPARSE = 1 / 32
#: What sums of doubles may be off by, as a share of the product of norms.
ERROR = 1e-12
#: Scores are kept within these; 64 bits hold their negatives too.
MOST = 2**63 - 1
LEAST = -MOST


def vectors(embeddings: DataFrame) -> DataFrame:
    """embeddings(vec_id, embedding) to row, vec_id, vector: floor(SCALE * x), x as double, as whole doubles. Rows without an
    id, and vectors that are null or hold null or non-finite components, take no part; nor do ones that scaling takes
    beyond the range of doubles. Repeated ids and repeated rows are rows of their own, told by row."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE)
    # from 2^53 on a double is whole
    whole = F.transform("v", lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    return rows.where(finite).select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("vector"))


def _matrix(rows: list[list[float]], width: int) -> np.ndarray:
    """Rows of one width: shorter vectors end in zeros, which add nothing to an inner product."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : min(len(r), width)] = r[:width]
    return out


class Index:
    """A block's vectors: posting segments by falling impact, and the norm of what follows each."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.ids, self.rows = x, ids, rows
        size = np.abs(x)
        with np.errstate(over="ignore"):
            rest = (x**2).sum(1)
        self.norm = np.sqrt(rest)
        self.segments: list[tuple] = []
        self.rest: list[np.ndarray] = []
        if not np.isfinite(self.norm).all():
            return  # no bound: all are rescored
        level = np.where(size > 0, (np.frexp(size)[1] + 1) // 2, 0)
        for b in np.unique(level[level > 0])[::-1].tolist():
            vec, dim = np.nonzero(level == b)
            impact = x[vec, dim]
            here = np.unique(vec)
            if len(vec) <= SPARSE * x.shape[0] * x.shape[1]:
                order = np.argsort(dim, kind="stable")
                cuts = np.flatnonzero(np.diff(dim[order])) + 1
                self.segments.append((None, [(int(dim[p[0]]), vec[p], impact[p]) for p in np.split(order, cuts)]))
            else:
                dense = np.where(level[here] == b, x[here], 0.0)
                self.segments.append((slice(None) if len(here) == len(x) else here, dense))
            rest = np.maximum(rest - np.bincount(vec, impact**2, len(rest)), 0)
            self.rest.append(np.sqrt(rest))

    def _add(self, acc: np.ndarray, q: np.ndarray, segment: tuple) -> None:
        where, what = segment
        if where is None:
            for dim, vec, impact in what:  # a vector is in a dimension once
                acc[:, vec] += q[:, dim : dim + 1] * impact[None, :]
        else:
            acc[:, where] += q @ what.T

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """Of each query, by its place: the k best vectors' ids with their scores, ties to the smaller id; own: the queries' rows."""
        n = len(self.ids)
        acc = np.zeros((len(q), n))
        mine = own[:, None] == self.rows[None, :]
        possible = ~mine
        with np.errstate(over="ignore"):
            norm = np.sqrt((q**2).sum(1))
        if np.isfinite(norm).all():
            error = ERROR * norm[:, None] * self.norm[None, :] + 1e-6
            for segment, rest in zip(self.segments, self.rest, strict=True):
                self._add(acc, q, segment)
                slack = norm[:, None] * rest[None, :] * (1 + 1e-9) + error
                if n > k:
                    low, high = (np.clip(bound, LEAST, MOST) for bound in (acc - slack, acc + slack))
                    least = np.partition(np.where(mine, -np.inf, low), n - k, axis=1)[:, n - k]
                    possible = ~mine & (high >= least[:, None])
                if possible.mean() <= FEW:
                    break
        for i in range(len(q)):
            found = np.flatnonzero(possible[i])
            exact = self._exact(found, q[i])
            best = np.lexsort((self.ids[found], -exact))[:k]
            yield i, self.ids[found[best]], exact[best].tolist()

    def _exact(self, found: np.ndarray, q: np.ndarray) -> np.ndarray:
        x = self.x[found]
        top = [float(np.abs(m).max(initial=0)) for m in (x, q)]
        if max(*top, top[0] * top[1] * len(q)) < 2.0**62:
            return x.astype(np.int64) @ q.astype(np.int64)
        whole = [int(c) for c in q.tolist()]
        exact = (sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x.tolist())
        return np.array([min(max(s, LEAST), MOST) for s in exact], np.int64)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The parts of a sorted batch that are of one block and kind."""
    key = np.stack([batch.column(c).to_numpy() for c in ("ib", "kind")])
    cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def searcher(k: int):
    """Rows sorted by block and kind, the block's vectors (kind 0) before the queries (kind 1). A matrix is as wide as its block's
    longest vector; what a query has beyond meets nothing there."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, index, width, at_once = None, [], None, 1, BATCH
        for batch in batches:
            for run in _runs(batch) if batch.num_rows else ():
                if run.column("ib")[0].as_py() != block:
                    block, waiting, index = run.column("ib")[0].as_py(), [], None
                if run.column("kind")[0].as_py() == 0:
                    waiting.append((run.column("row").to_numpy(), run.column("vec_id").to_numpy(), run.column("vector")))
                    width = max(width if len(waiting) > 1 else 1, *(len(v) for v in run.column("vector")))
                    continue
                if not waiting and index is None:
                    continue  # no vector is in this block
                if index is None:
                    rows, ids = (np.concatenate([w[c] for w in waiting]) for c in (0, 1))
                    index, waiting = Index(np.concatenate([_matrix(w[2].to_pylist(), width) for w in waiting]), ids, rows), []
                    at_once = max(1, min(BATCH, SCORES // len(ids)))
                for low in range(0, run.num_rows, at_once):
                    some = run.slice(low, at_once)
                    own, asked = some.column("row").to_numpy(), some.column("vec_id").to_numpy()
                    out: tuple[list, list, list, list] = ([], [], [], [])
                    for i, ids, scores in index.search(_matrix(some.column("vector").to_pylist(), width), own, k):
                        for column, values in zip(out, ([own[i]] * len(ids), [asked[i]] * len(ids), ids.tolist(), scores), strict=True):
                            column.extend(values)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["row", "query_id", "vec_id", "score"])

    return tidy(search)


def top_k(index: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """index and queries (row, vec_id, vector) to query_id, rank, vec_id, score: the k best of all index rows for each query row.

    A query's own row is no candidate for it; another row of its id is. Equal scores rank by vec_id, rows equal in both in
    any order. A score beyond 64 bits counts as the nearest of LEAST and MOST. A query without candidates gives no rows, one with fewer than k gives all; an empty table on either side
    gives none. Vectors of different lengths are as if they ended in zeros. Other columns are ignored.
    """
    # blocks hold vectors of one order of length, so that no long one widens the matrix of many short ones
    order = F.ceil(F.log2(F.greatest(F.size("vector"), F.lit(1)))).cast("int")
    blocks, own = 0, F.lit(0)
    for r in index.groupBy(order.alias("order")).count().orderBy("order").collect():  # at most 32 rows
        n = -(-(r["count"] << r.order) // block)
        own = F.when(order == r.order, blocks + F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).otherwise(own)
        blocks += n
    blocks = max(1, blocks)
    left = index.select(own.alias("ib"), F.lit(0).alias("kind"), "row", "vec_id", "vector")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("ib"), F.lit(1).alias("kind"), "row", "vec_id", "vector")
    sorted_rows = left.unionByName(right).repartition(blocks, "ib").sortWithinPartitions("ib", "kind")
    found = sorted_rows.mapInArrow(searcher(k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null, or hold null or non-finite components, take no part; nor do rows without an id."""
    index = materialise(vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(index, index.where(F.col("vec_id") % EVERY == 0))


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.n <> b.n
), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""
