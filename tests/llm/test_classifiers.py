import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaflow.llm import quality, toxicity

shared = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the shared tables aren't here")
BAD = ["scumbag", "idiotic", "worthless"]


def texts(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        body = [rnd.choice(words) for _ in range(rnd.randrange(5, 200))]
        kind = rnd.random()
        toxic = int(kind < 0.25)
        if toxic:
            for _ in range(rnd.randrange(1, 7)):
                body.insert(rnd.randrange(len(body)), rnd.choice(BAD))
        good = int(rnd.random() < 0.7)
        text = " ".join(body) + "." if good else " ".join(w.upper() + "!!" for w in body)
        out.append((i, text, good, toxic))
    return out


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, *_ in rows], "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame([(i, g, b) for i, _, g, b in rows] + [(None, 1, 1), (10**6, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_on_held_out_texts(spark):
    rows = texts(600, 1)
    docs, labels = tables(spark, rows)
    model = toxicity.trained(docs, labels.where("doc_id < 400"))
    out = {r.doc_id: r for r in toxicity.judged(docs, model).collect()}
    late = rows[400:]
    assert np.mean([out[i].rejected == bool(b) for i, _, _, b in late]) > 0.97
    assert all(not out[i].rejected for i, _, _, b in late if not b)
    few, many = (np.mean([out[i].severity for i, t, _, b in late if b and sum(w in BAD for w in t.lower().split()) in n]) for n in ((1, 2), (5, 6)))
    assert many > few + 0.3  # severity is ordered
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in out.values())


def test_thresholds_are_ordered_and_slope_is_right():
    rng = np.random.default_rng(0)
    x = rng.normal(size=800)
    grade = np.digitize(x * 2 + rng.logistic(size=800), [-1.0, 1.5])
    weights, thresholds = toxicity._regress(np.arange(800), np.zeros(800, int), x, grade, 1, 2)
    assert weights[0] == pytest.approx(2, abs=0.4)
    assert thresholds == pytest.approx([-1.0, 1.5], abs=0.4)


def test_likelihood_against_a_plain_one():
    rng = np.random.default_rng(5)
    eta, cuts = rng.normal(size=40), np.array([-0.3, 0.4, 2.0])
    logistic = lambda z: 1 / (1 + np.exp(-z))
    for grade in range(4):
        below = [logistic(cuts[grade] - e) if grade < 3 else 1.0 for e in eta]
        under = [logistic(cuts[grade - 1] - e) if grade else 0.0 for e in eta]
        assert toxicity.likelihood(eta, np.full(40, grade), cuts) == pytest.approx(np.subtract(below, under))


def test_steps_climb_to_the_best_likelihood():
    rng = np.random.default_rng(6)
    r, c, v = np.repeat(np.arange(300), 2), np.tile([0, 1], 300), rng.random(600)
    grade = rng.integers(0, 3, 300)
    w, t = toxicity._regress(r, c, v, grade, 2, 2)

    def penalised(w, t):
        eta = np.array([v[2 * i] * w[0] + v[2 * i + 1] * w[1] for i in range(300)])
        return np.log(toxicity.likelihood(eta, grade, t)).mean() - toxicity.RIDGE * (w**2).sum() / 2 / np.sqrt(300)

    best = penalised(w, t)
    for d in (np.array([0.05, 0]), np.array([0, 0.05])):
        assert best >= max(penalised(w + d, t), penalised(w - d, t), penalised(w, t + d), penalised(w, t - d)) - 1e-6


def test_severity_against_a_plain_sum():
    model = toxicity.Model({"bad": 0, "badl-": 1, "b\u00f6se": 2}, np.array([1.0, 0.5, -2.0]), np.array([1.0, 3.0]))
    said = ["Bad bad, badly!", "b\u00f6se BADLANDS", "none", None]
    eta = [np.log(3) + 0.5 * np.log(2), 0.5 * np.log(2) - 2 * np.log(2), 0, 0]
    want = [sum(1 / (1 + np.exp(t - e)) for t in (1.0, 3.0)) for e in eta]
    assert model.severity(said, {}) == pytest.approx(want)


@shared
def test_toxicity_on_the_labels(spark):
    """Fitted on half of the given labels, the model tells the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = toxicity.trained(docs, labels.where(half == 0))
    rows = toxicity.judged(docs, model).join(labels.where(half == 1), "doc_id").collect()
    assert np.mean([r.rejected == bool(r.toxic) for r in rows]) > 0.95
    assert np.mean([r.rejected for r in rows if not r.toxic]) < 0.01


def test_a_column_of_the_internal_name(spark):
    docs, labels = tables(spark, texts(100, 7))
    docs = docs.withColumn("__severity", F.lit("mine"))
    kept = toxicity.accepted(docs, toxicity.trained(docs, labels))
    assert kept.columns == docs.columns and {r["__severity"] for r in kept.collect()} == {"mine"}


def test_toxicity_of_odd_texts(spark):
    docs, labels = tables(spark, texts(200, 2))
    model = toxicity.trained(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, None), (4, "w " * 300_000)], "doc_id long, text string")
    assert [r.rejected for r in toxicity.judged(odd, model).collect()] == [False] * 5
    assert toxicity.judged(odd.limit(0), model).collect() == []
    none = toxicity.trained(docs, labels.limit(0))
    assert not any(r.rejected for r in toxicity.judged(docs, none).collect())


def test_quality_on_held_out_texts(spark):
    rows = texts(800, 3)
    docs, labels = tables(spark, rows)
    out = {r.doc_id: r for r in quality.scored(docs, quality.trained(docs, labels)).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    late = [r for r in rows if out[r[0]].held_out]
    assert np.mean([out[i].predicted == g for i, _, g, _ in late]) > 0.97
    assert all(out[i].predicted == int(out[i].score >= 0.7) and 0 <= out[i].score <= 1 for i, *_ in rows)


def test_held_out_labels_are_not_learned(spark):
    rows = texts(300, 4)
    docs, labels = tables(spark, rows)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.trained(docs, x) for x in (labels, flipped))
    assert a.base == b.base and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_additive_lookup():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9


def test_scores_against_a_plain_sum():
    rng = np.random.default_rng(8)
    x = rng.random((200, 3))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    for row, score in zip(x.tolist(), model.score(x), strict=True):
        bin_of = lambda cuts, value: sum(value >= c for c in cuts)
        z = model.base + sum(t[bin_of(c, v)] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
        z += sum(t[bin_of(a, row[i]), bin_of(b, row[j])] for i, j, a, b, t in model.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-min(max(z, -30), 30))))


@shared
def test_quality_on_the_labels(spark):
    """Of the given labels, the held-out ones are told."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scored(docs, quality.trained(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_of_odd_texts(spark):
    docs, labels = tables(spark, texts(200, 5))
    model = quality.trained(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, None), (4, "w " * 300_000), (5, "\n \n")], "doc_id long, text string")
    rows = quality.scored(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert quality.scored(odd.limit(0), model).collect() == []
    assert {r.score for r in quality.scored(docs, quality.trained(docs, labels.limit(0))).collect()} == {0.5}


def test_many_texts_of_one_labelled_id_are_one(spark, monkeypatch):
    """What reaches the driver follows the sample, whatever repeats: one text of each id, the one of least hash."""
    docs = spark.createDataFrame([(8, f"words number {i} stand here") for i in range(3000)] + [(9, "worthless scumbag")] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(8, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda x, y: sizes.append((x.shape[0], sorted(y.tolist()))))
    quality.trained(docs, labels, sample=5)
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda vectors, *_: fitted.append(vectors))
    toxicity.trained(docs, labels, sample=5)
    assert sizes == [(2, [0.0, 1.0])]
    assert len(fitted[0].toxic) == 2
