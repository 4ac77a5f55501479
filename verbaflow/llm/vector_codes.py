"""Vector code compression: product codes over codebooks that rounds of exact nearest search and integer means refine.

A vector of whole components is cut into PARTS equal parts, and each part position has a codebook of ENTRIES entries. In
each round the driver builds a kd-tree of every codebook and broadcasts them; a task takes its vectors through the trees
by branch and bound, many at once: a node is entered if its box is as near as the best entry so far or nearer, so that of
equally near entries the lowest index survives. What tasks return for an update is a count and integer sums for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, tidy, unused

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries of a leaf, which are looked at together.
LEAF = 6
#: Vectors that are taken through the trees at once.
BATCH = 8192
#: Labels that are broadcast with their errors, at most; beyond, a join shuffles.
FEW_LABELS = 100_000


def reach(width: int) -> int:
    """What components are kept within, so that the squared distances of vectors of this width add up in 64 bits."""
    return 1 << ((62 - max(1, width - 1).bit_length()) // 2 - 1)


class Tree:
    """A kd-tree over the rows of a codebook, by medians of the widest axis; each node has the box of its entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple] = []
        if len(entries):
            self._build(np.arange(len(entries)))

    def _build(self, at: np.ndarray) -> int:
        own, some = len(self.nodes), self.entries[at]
        low, high = some.min(0), some.max(0)
        self.nodes.append(())
        if len(at) <= LEAF or (low == high).all():
            self.nodes[own] = (low, high, np.sort(at), None)
            return own
        axis = int(np.argmax(high - low))
        order = at[np.argsort(some[:, axis], kind="stable")]
        half = len(at) // 2
        self.nodes[own] = (low, high, None, (self._build(order[:half]), self._build(order[half:])))
        return own

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x the index of the nearest entry, the lowest of equally near ones, and its squared distance."""
        self.x, n = x, len(x)
        self.index, self.distance = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        every = np.arange(n)
        self._visit(0, every, self._bound(0, every))
        return self.index, self.distance

    def _bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        low, high, *_ = self.nodes[node]
        x = self.x[rows]
        gap = np.maximum(np.maximum(low - x, x - high), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def _visit(self, node: int, rows: np.ndarray, bound: np.ndarray) -> None:
        """Rows whose best is farther than their bound, or just as far, look into the node."""
        rows = rows[bound <= self.distance[rows]]
        if not len(rows):
            return
        _, _, leaf, below = self.nodes[node]
        if leaf is not None:
            for i in leaf.tolist():
                gap = self.x[rows] - self.entries[i]
                far = np.einsum("ij,ij->i", gap, gap)
                best = self.distance[rows]
                better = (far < best) | ((far == best) & (i < self.index[rows]))
                self.index[rows[better]], self.distance[rows[better]] = i, far[better]
            return
        bounds = [self._bound(child, rows) for child in below]
        left = bounds[0] <= bounds[1]  # the nearer box first
        for first, second, mine in ((0, 1, left), (1, 0, ~left)):
            self._visit(below[first], rows[mine], bounds[first][mine])
            self._visit(below[second], rows[mine], bounds[second][mine])


@dataclass
class Codebooks:
    """entries: part, entry, position within the part; whole numbers."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The vector that a code stands for."""
        return [x for part in range(len(self.entries)) for x in self.entries[part, int(code[2 * part : 2 * part + 2], 16)].tolist()]


def whole_vectors(embeddings: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """embeddings with vector, floor(scale * x) of every component as whole doubles, in place of the column. Rows whose vector
    is null or holds null or non-finite components are dropped. Other columns pass through."""
    scaled = F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(F.greatest(F.lit(-(2.0**52)), F.least(F.lit(2.0**52), x * scale))).cast("double"))
    finite = F.forall(F.col(column).cast("array<double>"), lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    rows = embeddings.where(F.col(column).isNotNull() & finite)
    if column != "vector":
        rows = rows.drop("vector")
    return rows.withColumn(column, scaled).withColumnRenamed(column, "vector")


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Shorter vectors end in zeros; components are kept within reach."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    most = reach(width)
    if (sizes == width).all():
        out = flat.reshape(len(sizes), width)
    else:
        out = np.zeros((len(sizes), width))
        out[np.arange(width) < sizes[:, None]] = flat
    return np.clip(out, -most, most).astype(np.int64)


def _assigned(batches: Iterator[pa.RecordBatch], column: str, books: Codebooks):
    """Slices of batches with their vectors by part (vector, part, position), the entries and the squared distances (part, vector)."""
    parts, _, long = books.entries.shape
    trees = [Tree(e) for e in books.entries]
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH):
            some = batch.slice(low, BATCH)
            x = _matrix(some.column(column), books.width).reshape(some.num_rows, parts, long)
            found = [tree.nearest(np.ascontiguousarray(x[:, p])) for p, tree in enumerate(trees)]
            yield some, x, np.stack([f[0] for f in found]), np.stack([f[1] for f in found])


def first_codebooks(vectors: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the least keys, ascending; None if there are no vectors or all are empty. Null keys come
    last, equal keys are in the order of their vectors. Widths are filled up with zeros to a multiple of parts."""
    widest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    if not widest:
        return None
    width = -(-widest // parts) * parts
    first = vectors.select(key, "vector").orderBy(F.col(key).asc_nulls_last(), "vector").limit(entries).collect()
    x = _matrix(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width)
    return Codebooks(np.ascontiguousarray(x.reshape(len(first), parts, width // parts).transpose(1, 0, 2)))


def refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each part goes to the nearest entry of its codebook, each entry becomes its parts' floored mean; entries
    without parts stay."""
    spark = vectors.sparkSession
    parts, n, long = books.entries.shape
    sent = spark.sparkContext.broadcast(books.entries)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, n), np.int64), np.zeros((parts, n, long), np.int64)
        for _, x, index, _ in _assigned(batches, "vector", Codebooks(sent.value)):
            for p in range(parts):
                counts[p] += np.bincount(index[p], minlength=n)
                np.add.at(sums[p], index[p], x[:, p])
        p, e = np.nonzero(counts)
        for i in range(long):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(np.full(len(p), i)), pa.array(counts[p, e]), pa.array(sums[p, e, i])], names=["part", "entry", "position", "n", "total"])

    each = vectors.select("vector").mapInArrow(tidy(add), "part long, entry long, position long, n long, total long")
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    rows = each.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), total.alias("total")).collect()  # a row for each number in the codebooks
    entries = books.entries.copy()
    for r in rows:
        entries[r.part, r.entry, r.position] = int(r.total) // r.n
    sent.unpersist()
    return Codebooks(entries)


def trained(vectors: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after the rounds; vectors as whole_vectors gives them."""
    books = first_codebooks(vectors, key, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(vectors, books)
    return books


def encoded(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """vectors with code, two hex digits for each part, and error, the squared distance to the decoded vector, in place of
    columns of these names and of vector. Without codebooks codes are empty and errors 0."""
    rest = vectors.drop("code", "error")
    if books is None:
        return rest.drop("vector").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")})
    sent = vectors.sparkSession.sparkContext.broadcast(books.entries)
    digits = np.array([f"{i:02x}" for i in range(256)])
    others = [c for c in rest.columns if c != "vector"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, index, distance in _assigned(batches, "vector", Codebooks(sent.value)):
            code = ["".join(row) for row in digits[index.T].tolist()]
            kept = [some.column(i) for i, name in enumerate(some.schema.names) if name != "vector"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(code, pa.string()), pa.array(distance.sum(0))], names=[*others, "code", "error"])

    schema = rest.drop("vector").schema.add("code", "string").add("error", "long")
    return rest.select("vector", *others).mapInArrow(tidy(encode), schema)


def with_label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes(label, error) with label_error, the errors of equal labels added up, nulls together; a sum beyond 64 bits is the
    greatest long. A hot label is added up before it is shuffled, and its rows are joined to one row."""
    own, most = unused(codes, "__label"), (1 << 63) - 1
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(most).cast("decimal(38,0)")).cast("long")
    each = codes.groupBy(F.col(label).alias(own)).agg(total.alias("label_error"))
    few = each.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return codes.drop("label_error").join(F.broadcast(each) if few else each, F.col(label).eqNullSafe(F.col(own)), "left").drop(own)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are null or hold null or non-finite components are dropped. Repeated ids and rows are rows of their own;
    null ids are kept. Shorter vectors are as if they ended in zeros, empty ones too; components are kept within reach(64),
    2^27, which is beyond what embeddings hold. With fewer than 64 vectors the codebooks are as small; an empty table gives no
    rows. Other columns are ignored."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    vectors = materialise(whole_vectors(rows), "vector-codes")
    books = trained(vectors, "vec_id")
    codes = materialise(encoded(vectors, books), "vector-codes-found")
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """The nearest entries before round i + 1, and the entries after it."""
    return f"""
a{i} AS (
  SELECT n, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (
    SELECT x.n, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{i} b USING (p)
  ) GROUP BY n, p
), m{i} AS (
  SELECT p, e, list(CAST(t AS BIGINT) ORDER BY j) AS v FROM (
    SELECT a.p, a.e, s.j, (sum(x.v[s.j]) - ((sum(x.v[s.j]) % count(*)) + count(*)) % count(*)) / count(*) AS t
    FROM a{i} a JOIN x ON x.n = a.n AND x.p = a.p CROSS JOIN (SELECT unnest(range(1, 5)) AS j) s GROUP BY a.p, a.e, s.j
  ) GROUP BY p, e
), b{i + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (p, e)),"""


OP13_SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (SELECT n, p, q[4 * p + 1 : 4 * p + 4] AS v FROM k CROSS JOIN (SELECT unnest(range({PARTS})) AS p)),
b0 AS (SELECT p, n - 1 AS e, v FROM x WHERE n <= {ENTRIES}),
{_round_sql(0)}{_round_sql(1)}
f AS (
  SELECT n, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (
    SELECT x.n, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b2 b USING (p)
  ) GROUP BY n, p
), r AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY n)
SELECT k.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM k JOIN r USING (n)
"""
