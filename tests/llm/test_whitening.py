import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaflow.llm import whitening as w


def rows_of(spark, rows, kind="float"):
    """With columns that clash with the operator's own."""
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"x": F.lit("a"), "whitened": F.lit(1), "deviation": F.lit("b")})


def plain(rows):
    kept = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64) + 100_000) for i, v in rows if v is not None and not any(c is None or not np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in kept], ((n * x - s) ** 2).sum(1), c, values[::-1], axes[:, ::-1]


def test_against_another_solver(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.1, (600, 12)) @ rng.normal(0, 1, (12, 12))
    x[rng.random(600) < 0.3] = x[5]  # one very common vector
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 12), (703, [float("-inf")] * 12), (3, rows[3][1]), (None, rows[4][1])]
    ids, deviation, c, values, axes = plain(rows)
    vectors = w.whole_vectors(rows_of(spark, rows).select("vec_id", "embedding").withColumn("__extra", F.lit(1)))
    model = w.fitted(vectors)
    assert model.n == len(ids)
    np.testing.assert_allclose(model.values, values, rtol=1e-9)
    found = w.whitened(vectors, model, 5).collect()
    key = lambda i, dev: (i is None, i or 0, dev)
    order = sorted(range(len(ids)), key=lambda k: key(ids[k], deviation[k]))
    got = sorted(found, key=lambda r: key(r.vec_id, r.deviation))
    assert [(r.vec_id, r.deviation) for r in got] == [(ids[k], deviation[k]) for k in order]
    want = (c @ axes[:, :5] / np.sqrt(values[:5]))[order]
    mine = np.array([r.whitened for r in got])
    mine *= np.sign((mine * want).sum(0))
    np.testing.assert_allclose(mine, want, atol=1e-8)
    assert w.identity_error(w.whitened(vectors, model, 5), model.n) < 1e-9
    assert sum(model.explained) == pytest.approx(1)


def test_small_eigenvalues_are_accurate():
    """A matrix whose rows and columns are scaled over eight decades: the small eigenvalues keep their digits."""
    rng = np.random.default_rng(2)
    core = np.eye(6) + 0.1 * rng.uniform(-1, 1, (6, 6))
    scale = np.diag([1e4, 1e3, 1e2, 1e-1, 1e-3, 1e-4])
    a = scale @ (core + core.T) / 2 @ scale
    values, axes = w.jacobi(a)
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    exact = [[Decimal(float(c)) for c in row] for row in a]

    def negative(shift):  # eigenvalues below shift, by Sylvester's law
        m = [[exact[i][j] - (shift if i == j else 0) for j in range(6)] for i in range(6)]
        count = 0
        for k in range(6):
            count += m[k][k] < 0
            for i in range(k + 1, 6):
                f = m[i][k] / m[k][k]
                for j in range(k, 6):
                    m[i][j] -= f * m[k][j]
        return count

    for place, e in enumerate(values):
        below = 6 - place - 1
        assert negative(Decimal(float(e)) * (1 - Decimal("1e-12"))) == below and negative(Decimal(float(e)) * (1 + Decimal("1e-12"))) == below + 1
    np.testing.assert_allclose(axes.T @ axes, np.eye(6), atol=1e-14)
    assert (axes[np.abs(axes).argmax(0), range(6)] > 0).all()


def test_odd_rows(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(w, "table", lambda *_: tables["t"])
    run = lambda rows, kind="float": (tables.update(t=rows_of(spark, rows, kind)), w.op11_embedding_whitening(spark, ""))[1].collect()
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, []), (2, [])]) == []
    # nothing varies
    (r, *_), = [run([(1, [0.5]), (2, [0.5])])[:1]]
    assert (r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 2, 0, None, None, None)
    # one direction: its component is whitened, the other is null; the short vector ends in zero
    got = sorted(run([(1, [1.0, 0.0]), (2, [-1.0])]), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component, r.whitened and round(r.whitened, 9)) for r in got] == [(1, 1, 1.0), (1, 2, None), (2, 1, -1.0), (2, 2, None)]
    assert got[0].explained == 1 and got[0].deviation == 2048**2 and got[0].identity_error < 1e-12
    # huge entries: whole numbers beyond 64 bits on the way
    got = run([(i, [1e300 * (i % 2), float(i)]) for i in range(6)], "double")
    assert {r.deviation for r in got} == {w.LONGEST} and len(got) == 12


def test_whole_table(spark):
    rows = w.op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(rows) == 8 * n and {r.n for r in rows} == {n}
    assert rows[0].identity_error < 1e-9
