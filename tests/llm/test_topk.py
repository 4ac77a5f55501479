import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaflow.llm import topk_search as t


def brute(rows, k=5, every=50):
    kept = [(i, [int(x) for x in np.floor(256 * np.array(v, np.float64)).tolist()]) for i, v in rows if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(kept):
        if i % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=False)), t.LEAST), t.MOST), j) for m, (j, w) in enumerate(kept) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, kind="float", **sizes):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit("x")).withColumn("row", F.lit(1))
    index = t.materialise(t.vectors(df), "test-vectors")
    return sorted(map(tuple, t.top_k(index, index.where(F.col("vec_id") % t.EVERY == 0), **sizes).collect()))


@pytest.mark.parametrize("sizes", [{}, {"block": 600}])
def test_against_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 0.12, (400, 16)), 3)
    x[rng.random(400) < 0.3] = x[7]  # one very common vector: ties go to the smaller id
    x[50] *= 40
    x[60:80] = 0
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(500, None), (501, [1.0, None]), (550, [float("nan")] * 16), (600, [float("inf")] * 16), (None, [1.0] * 16), (650, []), (700, [0.5, 0.25])]
    # repeated ids, repeated rows, also of queries
    rows += [(3, rows[9][1]), (3, rows[9][1]), (100, rows[100][1]), (100, rows[50][1]), (50, rows[50][1])]
    assert found(spark, rows, **sizes) == brute(rows)


def test_large_values(spark):
    rows = [(i, [float(2.0**22 + i), float(-(2.0**21)), float(i)]) for i in range(60)]
    assert found(spark, rows, "double") == brute(rows)
    rows += [(100, [1e10, 3.0, 1.0]), (101, [1e10, 1e10, 0.0]), (150, [-1e300, 1.0]), (151, [2.0**70, 1.0, 5.0]), (152, [3.0**40 + 1, -7.0])]
    assert found(spark, rows, "double") == brute(rows)


def test_few_and_none(spark):
    assert found(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])]) == [(0, 1, 1, 131072), (0, 2, 2, -65536)]
    assert found(spark, [(50, [1.0])]) == []
    assert found(spark, []) == []


def test_segments_stop_on_proof():
    rng = np.random.default_rng(2)
    x = rng.integers(-20, 20, (2000, 32)).astype(float)
    x[5], x[9] = 90, 80
    index = t.Index(x, np.arange(2000), np.arange(2000))
    added = []
    index._add = lambda acc, q, segment, add=index._add: (added.append(1), add(acc, q, segment))
    (_, ids, scores), = index.search(np.full((1, 32), 70.0), np.array([-1]), 2)
    assert ids.tolist() == [5, 9] and scores == [90 * 70 * 32, 80 * 70 * 32]
    assert len(added) < len(index.segments)


def test_sparse_and_dense_segments_agree():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (200, 12)) * (rng.random((200, 12)) < 0.05) + (rng.random((200, 12)) < 0.9)
    index = t.Index(x.astype(float), np.arange(200), np.arange(200))
    assert {where is None for where, _ in index.segments} == {True, False}
    q, acc = rng.integers(-50, 50, (4, 12)).astype(float), np.zeros((4, 200))
    for segment in index.segments:
        index._add(acc, q, segment)
    assert (acc == q @ x.T).all()


def test_long_vectors_stand_apart_and_scores_are_bounded(spark, monkeypatch):
    """One long vector widens no other block, and many narrow ones are scored for few queries at once."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 3).round(2).tolist()) for i in range(300)] + [(350, rng.normal(0, 1, 5000).round(2).tolist()), (351, rng.normal(0, 1, 4500).round(2).tolist())]
    shapes = []
    matrix, scores = t._matrix, t.Index.search
    sizes = []
    monkeypatch.setattr(t, "SCORES", 1000)
    monkeypatch.setattr(t.Index, "search", lambda self, q, own, k: (sizes.append(len(q) * len(self.ids)), scores(self, q, own, k))[1])
    monkeypatch.setattr(t, "_matrix", lambda vs, width: (shapes.append((len(vs), width)), matrix(vs, width))[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = t.materialise(t.vectors(df), "test-vectors")
    search = t.searcher(5)
    assert sorted(map(tuple, t.top_k(index, index.where(F.col("vec_id") % t.EVERY == 0)).collect())) == brute(rows)
    # the same in this process, where what it holds can be seen
    import pyarrow as pa

    kept = [(i, r.row, r.vec_id, r.vector) for i, r in enumerate(index.where("vec_id < 300").collect())]
    columns = lambda kind, some: [pa.array([0] * len(some), pa.int32()), pa.array([kind] * len(some), pa.int32()), *(pa.array(c) for c in zip(*[x[1:] for x in some], strict=True))]
    names = ["ib", "kind", "row", "vec_id", "vector"]
    list(search(iter([pa.RecordBatch.from_arrays(columns(0, kept), names=names), pa.RecordBatch.from_arrays(columns(1, kept[:60]), names=names)])))
    assert {w for _, w in shapes} == {3} and max(sizes) <= 1000
