import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaflow.llm import jaccard_join as j


def plain(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                top[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root(n)] = min(least.get(root(n), i), i)
    return sorted((i, len(sets[n]), least[root(n)]) for n, (i, _) in enumerate(rows))


def corpus(seed, n):
    rnd = random.Random(seed)
    v = [f"w{i}" for i in range(200)]
    base = [[rnd.choice(v) for _ in range(rnd.choice([4, 6, 30, 80]))] for _ in range(6)]
    passage = [rnd.choice(v) for _ in range(25)]
    rows = []
    for k in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 8])):
            w[rnd.randrange(len(w))] = rnd.choice(v)
        if rnd.random() < 0.4:
            at = rnd.randrange(len(w))
            w[at:at] = passage
        rows.append((k * 3 % 1009, " ".join(w).upper() if rnd.random() < 0.1 else " ".join(w)))
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One \t two"), (9005, "one"), (9006, "One two\u00a0")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "q", 0) for i, t in rows], "doc_id long, text string, id string, comp int").repartition(3)


@pytest.mark.parametrize("hot", [4096, 6])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(j, "HOT", hot)
    rows = corpus(hot, 250)
    assert sorted(map(tuple, j.near_duplicates(frame(spark, rows)).collect())) == plain(rows)


def test_repeated_rows_and_empty(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (3, "A b c d e f g"), (7, "other")]
    out = sorted(map(tuple, j.near_duplicates(frame(spark, rows)).collect()))
    assert out == [(3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 1, 7)]
    assert j.near_duplicates(frame(spark, []).limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (3, "A b c d e f g"), (7, "other"), (8, None), (None, "x"), (None, "x")]
    out = j.deduplicated(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "id", "comp"]
    assert sorted(((r.doc_id or -1), r.text) for r in out.collect() if r.text) == [(-1, "x"), (-1, "x"), (3, "A b c d e f g"), (7, "other")]


def test_rows_of_one_id_are_told_apart(spark):
    same = "a b c d e f g"
    rows = [(1, same), (4, same), (4, "quite another text"), (4, "quite another text"), (4, "a third one"), (9, "A third one"), (9, "\x1c"), (9, " \n"), (9, None), (None, same), (None, "a fourth one")]
    out = sorted((r.doc_id or -1, r.text or "") for r in j.deduplicated(frame(spark, rows)).collect())
    assert out == [(-1, "a fourth one"), (1, same), (4, "a third one"), (4, "quite another text"), (9, ""), (9, "\x1c"), (9, " \n")]
    assert j.deduplicated(frame(spark, rows[:1]).limit(0)).collect() == []


def test_odd_rows_and_columns_of_internal_names(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, long), (2, long + " end"), (3, ""), (None, None), (None, "a b"), (None, "a b")]
    df = spark.createDataFrame([(*r, "k", 1, "i") for r in rows], "doc_id long, text string, __key string, comp int, __id string")
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in j.near_duplicates(df).collect())
    n = 200_000 - 4
    assert out == [(0, 0, 0), (0, 1, 0), (0, 1, 0), (0, n, 2), (2, n + 1, 2), (3, 0, 3)]
    kept = j.deduplicated(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in got) == [(0, 0), (0, 3), (0, 3), (2, len(long) + 4), (3, 0)]
    assert {(r["__key"], r["__id"]) for r in got} == {("k", "i")}


def test_a_passage_once_in_each_of_many_partitions(spark):
    """The sketch counts what every task meets once only, and so does the order of shingles."""
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(i, f"{passage} " + " ".join(f"u{i}x{k}" for k in range(40))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"))
    survey = df.mapInArrow(j._surveyor(5), "block int, doc_id long, id long, n long, data binary, key string, marks binary")
    shares = j.materialise(survey.where("block >= 0").select("block", "data"), "test-sketch")
    counts = np.frombuffer(j._whole_sketch(shares), np.uint32)
    common = next(j.Shingler(5).sets([passage.encode()]))
    assert (counts[j._cells(common)] >= 40).all()
    sent = spark.sparkContext.broadcast(counts.tobytes())
    posted = {r.sh for r in df.mapInArrow(j._poster(sent, frozenset(), 5, (75, 100)), "sh long, salt int, id long, size int, pos int").collect()}
    assert not posted & set(common.view(np.int64).tolist())


def test_marks_never_refuse_a_link():
    rng = np.random.default_rng(11)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(0, len(a) + 1)], b[: rng.integers(0, 20)]]))
        apart = len(np.setxor1d(a, b))
        assert j.distance(j.marks_of(a), j.marks_of(b)) <= apart
        if len(b) and j.linked(a, b):
            assert apart <= len(a) + len(b) - 2 * j.least_common(len(a), len(b), (75, 100))


def test_a_dense_group_is_linked_as_by_brute_force(spark, monkeypatch):
    """Near copies of one text with few and many changes: lists are long, and links run between some members only."""
    monkeypatch.setattr(j, "SIDE", 16)
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for n in range(150):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5])):
            w[rnd.randrange(len(w))] = f"c{rnd.randrange(10**6)}"
        rows.append((n, " ".join(w)))
    assert sorted(map(tuple, j.near_duplicates(frame(spark, rows)).collect())) == plain(rows)


@pytest.mark.parametrize("each", [100_000, 5])
def test_components(spark, monkeypatch, each):
    monkeypatch.setattr(j, "LINKS", each)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(-5, 40), (40, 50)], "a long, b long")
    got = {r.id: r.comp for r in j.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, -5: -5, 40: -5, 50: -5}


def test_filters_lose_no_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(0, len(a) + 1)], rng.integers(0, 60, 3).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        link = 100 * both >= 75 * (len(a) + len(b) - both)
        assert j.linked(a, b) == link
        if link:
            p, q = (set(x[: len(x) - j.least_overlap(len(x)) + 1].tolist()) for x in (a, b))
            s = min(p & q)
            i, k = int(np.searchsorted(a, np.uint64(s))), int(np.searchsorted(b, np.uint64(s)))
            assert j.near_enough(*map(np.array, (len(a), i, len(b), k)), (75, 100))


def test_ids_that_clash(spark):
    """Sets whose digests agree in the first half are told apart by the second."""
    digest = (5).to_bytes(8, "little") + (-7).to_bytes(8, "little", signed=True)
    row = spark.createDataFrame([(5, bytearray(digest)), (6, bytearray(digest))], "id long, data binary")
    assert [r[0] for r in row.select(j._own_id(frozenset({5}))).collect()] == [-7, 6]
    s = np.arange(3, dtype=np.uint64)
    first, whole = j._identity(s, frozenset())
    assert j._identity(s, frozenset({first}))[0] == int.from_bytes(whole[8:], "little", signed=True)
