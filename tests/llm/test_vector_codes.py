import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaflow.llm import vector_codes as v


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract, vector by vector."""
    kept = [(i, [int(c) for c in np.floor(256 * np.array(x, np.float64)).tolist()], label) for i, x, label in rows if x is not None and not any(c is None or not np.isfinite(c) for c in x)]
    long = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * long : (p + 1) * long]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x, p) for _, x, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, p: min((far(cut(x, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[nearest(x, p)[1] for p in range(parts)] for _, x, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                some = [cut(x, p) for (_, x, _), o in zip(kept, own, strict=True) if o[p] == k]
                if some:
                    books[p] = [*books[p][:k], [sum(c) // len(some) for c in zip(*some, strict=True)], *books[p][k + 1 :]]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, x, label in kept:
        found = [nearest(x, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=str)


def run(spark, monkeypatch, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"vector": F.lit("a"), "code": F.lit(1), "error": F.lit("b"), "__label": F.lit(2)})
    monkeypatch.setattr(v, "table", lambda *_: df)
    return sorted(map(tuple, v.op13_vector_codes(spark, "").collect()), key=str)


@pytest.mark.parametrize("width", [16, 48])
def test_against_brute_force(spark, monkeypatch, width):
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(0, 0.02, (220, width)), 2)  # small whole numbers: many equal distances
    x[rng.random(220) < 0.3] = x[9]  # one very common vector
    rows = [(i, [float(np.float32(c)) for c in row], [None, 1, 2][i % 3]) for i, row in enumerate(x)]
    rows += [(300, None, 1), (301, [None] * width, 1), (302, [float("nan")] * width, 2), (303, [float("inf")] * width, None), (4, rows[4][1], 1), (4, rows[5][1], 1), (None, rows[6][1], 2)]
    rows = rows[::-1]
    assert run(spark, monkeypatch, rows) == plain(rows)


def test_trees_agree_with_brute_force_on_ties():
    rng = np.random.default_rng(3)
    for n, d, spread in ((64, 4, 3), (64, 2, 1), (1, 4, 5), (37, 1, 20), (64, 6, 400)):
        e, x = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread - 1, spread + 2, (500, d))
        tree = v.Tree(e)
        index, far = tree.nearest(x)
        every = ((x[:, None, :] - e[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (far == every.min(1)).all()  # argmin takes the first


def test_trees_leave_nodes_out():
    rng = np.random.default_rng(4)
    tree = v.Tree(rng.integers(-500, 500, (64, 4)))
    entered = []
    visit = tree._visit
    tree._visit = lambda node, rows, bound: (entered.append(int((bound <= tree.distance[rows]).sum())), visit(node, rows, bound))[1]
    tree.nearest(rng.integers(-500, 500, (1000, 4)))
    assert sum(entered) < 0.6 * 1000 * len(tree.nodes)


def test_codes_decode(spark):
    df = spark.createDataFrame([(i, [i / 8, -i / 8, 0.0, 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    vectors = v.whole_vectors(df)
    books = v.trained(vectors, "vec_id", parts=2)
    for r in v.encoded(vectors, books).collect():
        x = [32 * r.vec_id, -32 * r.vec_id, 0, 256]
        assert sum((a - b) ** 2 for a, b in zip(x, books.decoded(r.code), strict=True)) == r.error == 0


def test_odd_rows(spark, monkeypatch):
    assert run(spark, monkeypatch, []) == [] and run(spark, monkeypatch, [(1, None, 1)]) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, monkeypatch, [(1, [], 1), (2, [], None)]) == [(1, "", 0, 0, empty), (2, "", 0, 0, empty)]
    # short vectors end in zeros, huge components are kept within reach; one error is the whole of its label's
    (a, b) = run(spark, monkeypatch, [(1, [1.0], 1), (2, [1e300] * 16, None)], "double")
    assert (a[:4], b[:4]) == ((1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0))
    assert v.reach(64) == 1 << 27 and 64 * (2 * v.reach(64)) ** 2 < 2**63
