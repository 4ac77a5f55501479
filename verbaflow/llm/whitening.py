"""Embedding whitening by cyclic Jacobi.

Components are whole numbers, floor(SCALE * c) + SHIFT, so that sums are exact and centring, (n x - S) / n, loses nothing
before it multiplies. Tasks add up the centred products of their vectors; Spark adds those of the tasks. The driver turns
the covariance by symmetric Jacobi rotations, pair after pair, until every off-diagonal entry has vanished against the two
diagonal entries that it stands between, which gives small eigenvalues to the precision of large ones. The scaled
eigenvectors are the whitening matrix, which is broadcast. The driver and the tasks hold matrices of the vectors' width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import materialise, table, tidy

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries are kept within these, so that they are whole doubles too.
MOST = 2**52
#: An off-diagonal entry has vanished if it is this share of the root of its diagonal entries' product, or less.
VANISHED = 2.0**-53
SWEEPS = 60
#: Eigenvalues that are this share of the greatest, or less, are those of directions in which nothing varies.
FLAT = 1e-13
LONGEST = 2**63 - 1


def whole_vectors(embeddings: DataFrame, column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """embeddings with x, floor(scale * c) + shift of every entry as longs, in place of the column. Rows whose vector is null or
    holds null or non-finite entries are dropped. Other columns pass through."""
    bound = F.lit(float(MOST))
    whole = F.transform(F.col(column).cast("array<double>"), lambda c: F.floor(F.greatest(-bound, F.least(bound, c * scale))) + F.lit(shift).cast("long"))
    finite = F.forall(F.col(column).cast("array<double>"), lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    rows = embeddings.where(F.col(column).isNotNull() & finite)
    if column != "x":
        rows = rows.drop("x")
    return rows.withColumn(column, whole).withColumnRenamed(column, "x")


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix by falling size, and unit eigenvectors as columns. An eigenvector's entry of the
    largest absolute value, the first of equal ones, is positive."""
    a, d = matrix.astype(float).copy(), len(matrix)
    v = np.eye(d)
    for _ in range(SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if off == 0 or abs(off) <= VANISHED * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                    continue
                turned = True
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = np.copysign(1, half) / (abs(half) + np.hypot(half, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                pp, qq = a[p, p] - t * off, a[q, q] + t * off
                p_row, q_row = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[:, p], a[q], a[:, q] = p_row, p_row, q_row, q_row
                a[p, p], a[q, q], a[p, q], a[q, p] = pp, qq, 0, 0
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(d)]) if d else np.ones(0)
    return np.diag(a)[order], v * np.where(sign == 0, 1, sign)


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of each dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace > 0 else None for e in self.values]

    def matrix(self, k: int) -> np.ndarray:
        """What centred vectors are multiplied with: a column for each of the first k components; NaN where nothing varies."""
        e = self.values[:k].copy()
        e[e <= FLAT * max(float(self.values[0]) if len(self.values) else 0, 0)] = np.nan
        return self.vectors[:, :k] / np.sqrt(e)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), SHIFT, np.int64)  # as if they ended in zeros
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S: whole numbers, as Python's own where 64 bits might not hold them."""
    if n * (2 * int(np.abs(x).max(initial=0)) + 1) < 2**62 and all(abs(s) < 2**62 for s in sums):
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _scatter(spark: SparkSession, rows: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all rows of their products: of(batch) gives centred doubles, a row for each of the batch's."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                c = of(batch.slice(low, 4096))
                total += c.T @ c
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = rows.mapInArrow(tidy(add), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width, width))
    for r in cells:
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def fitted(vectors: DataFrame) -> Whitening | None:
    """The whitening of vectors(x); None if there are none, or all are empty."""
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not width:
        return None
    each = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("k"))
    sums = [n * SHIFT] * width
    for r in each.collect():  # a row for each dimension
        sums[r.i] = int(r.s) + (n - r.k) * SHIFT

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (_centred(_matrix(batch.column(0), width), n, sums) / n).astype(float)

    covariance = _scatter(spark, vectors.select("x"), centred, width) / n
    values, axes = jacobi(covariance)
    return Whitening(n, sums, values, axes, float(np.trace(covariance)))


def whitened(vectors: DataFrame, model: Whitening, k: int = COMPONENTS) -> DataFrame:
    """vectors with deviation, the sum over dimensions of (n x - S)^2, the greatest long if it is beyond, and whitened, an
    array of the first k components (null where the data don't vary), in place of x and columns of these names."""
    width, n, sums = len(model.sums), model.n, model.sums
    sent = vectors.sparkSession.sparkContext.broadcast(model.matrix(k))
    rest = vectors.drop("deviation", "whitened")
    others = [c for c in rest.columns if c != "x"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                some = batch.slice(low, 4096)
                whole = _centred(_matrix(some.column("x"), width), n, sums)
                if whole.dtype == object or int(np.abs(whole).max(initial=0)) ** 2 * width > LONGEST:
                    deviation = [min(sum(int(c) ** 2 for c in row), LONGEST) for row in whole.tolist()]
                else:
                    deviation = np.einsum("ij,ij->i", whole, whole)
                w = (whole / n).astype(float) @ sent.value
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel(), from_pandas=True))
                kept = [some.column(i) for i, name in enumerate(some.schema.names) if name != "x"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(deviation, pa.int64()), lists], names=[*others, "deviation", "whitened"])

    schema = rest.drop("x").schema.add("deviation", "long").add("whitened", ArrayType(DoubleType()))
    return rest.select("x", *others).mapInArrow(tidy(project), schema)


def identity_error(rows: DataFrame, n: int) -> float | None:
    """The largest absolute entry of the covariance of rows(whitened) minus the identity, over components that vary; None
    if there are none."""
    means = rows.select(F.posexplode("whitened").alias("i", "w")).where("w IS NOT NULL").groupBy("i").agg(F.avg("w").alias("m")).orderBy("i").collect()
    if not means:
        return None
    at, mean = [r.i for r in means], np.array([r.m for r in means])

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return flat[:, at] - mean

    return float(np.abs(_scatter(rows.sparkSession, rows.select("whitened"), centred, len(at)) / n - np.eye(len(at))).max())


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids and rows are rows of their own, null ids are kept. Shorter vectors are as if they ended in zeros, empty
    ones too. Entries beyond 2^52 count as the nearest of +-2^52. A component in whose direction nothing varies has whitened
    null, and explained null if nothing varies at all; n and S are exact. An empty table, or one of empty vectors, gives no
    rows. Other columns are ignored. Of equal eigenvalues any order."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors = materialise(whole_vectors(rows), "whitening")
    model = fitted(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = materialise(whitened(vectors, model), "whitened")
    error = F.lit(identity_error(found, model.n)).cast("double")
    explained = F.array(*(F.lit(e).cast("double") for e in model.explained[:COMPONENTS]))
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), error.alias("identity_error"))
