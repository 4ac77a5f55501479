import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaflow.functions.lexicon import Lexicon
from verbaflow.operators import hmm


def model(seed, tags=("A", "B", "C"), frequent=("x", "y")):
    r = np.random.default_rng(seed)
    names = hmm.symbols(list(frequent))
    share = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(r.random(shape) + 0.05)
    return hmm.Hmm(list(frequent), share(len(tags)), share(len(tags), len(tags)), share(len(tags), len(names)), tags)


def paths(m, seq):
    """Every path of tags with its probability."""
    k = len(m.tags)
    for tags in itertools.product(range(k), repeat=len(seq)):
        p = m.start[tags[0]] * m.emission[tags[0], seq[0]]
        for t in range(1, len(seq)):
            p *= m.transition[tags[t - 1], tags[t]] * m.emission[tags[t], seq[t]]
        yield tags, p


def test_forward_backward_against_all_paths():
    m, r = model(1), np.random.default_rng(2)
    seqs = [r.integers(0, m.emission.shape[1], n) for n in (1, 4, 2, 5, 1, 3)]
    like, start, move, word = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros(m.emission.shape)
    for seq in seqs:
        every = list(paths(m, seq))
        total = sum(p for _, p in every)
        like += np.log(total)
        for tags, p in every:
            start[tags[0]] += p / total
            for t, tag in enumerate(tags):
                word[tag, seq[t]] += p / total
                if t:
                    move[tags[t - 1], tag] += p / total
    got = hmm.expected(m, [*seqs, np.array([], int)])
    for a, b in zip(got, (like, start, move, word), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-10)


def test_decoding_against_all_paths(spark):
    m, r = model(3), np.random.default_rng(4)
    seqs = [r.integers(0, m.emission.shape[1], n).tolist() for n in (1, 2, 3, 5, 6, 6, 4)] + [[]]
    start, move, word = (np.array(x) for x in m.scores())
    k = 3

    def score(tags, seq):
        return sum((start[a] if t == 0 else move[tags[t - 1] * k + a]) + word[seq[t] * k + a] for t, a in enumerate(tags))

    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, symbols array<int>")
    got = {x.id: x.tags for x in rows.select("id", hmm.decoded(F.col("symbols"), m).alias("tags")).collect()}
    for i, seq in enumerate(seqs):
        tags = [m.tags.index(t) for t in got[i]]
        assert len(tags) == len(seq)
        if seq:
            assert score(tags, seq) == max(score(t, seq) for t in itertools.product(range(k), repeat=len(seq)))


TEXTS = ["The dog runs to the big house.", "A man can run, and the dogs ran.", "She was walking slowly with 3 dogs in London.", "It stopped.", "", None, "They walked to the old town and he stayed."] * 8


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_likelihood_never_falls(spark, docs):
    rows = hmm.sequences(docs)
    first = hmm.counted(rows, ["the", "to", "dogs"])
    for part in (first.start, first.transition.sum(1), first.emission.sum(1)):
        np.testing.assert_allclose(part.sum() if part is first.start else part, 1)
    ids = hmm.symbol_ids(rows, first.frequent).repartition(3)
    last, said = hmm.fitted(ids, first, 6)
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(said)) and said[-1] > said[0]
    np.testing.assert_allclose(last.transition.sum(1), 1)
    # the same as in one process
    seqs = [np.array(r.symbols) for r in ids.collect()]
    assert hmm.expected(first, seqs)[0] == pytest.approx(said[0])


def test_tags(spark, docs):
    rows = hmm.sequences(docs)
    frequent = hmm.frequent_words(rows.select(F.explode("tokens").alias("token")), 10)
    assert frequent[:2] == [".", "the"]
    m = hmm.counted(rows, frequent)
    found = {}
    for r in hmm.tagged(docs, m).collect():
        found.setdefault(r.doc_id, []).append((r.pos, r.token, r.tag))
    got = [(t, tag) for _, t, tag in sorted(found[0])]
    assert [t for t, _ in got] == ["The", "dog", "runs", "to", "the", "big", "house", "."]
    assert dict(got)["The"] == "DT" and dict(got)["to"] == "TO" and dict(got)["."] == "."
    assert 4 not in found and 5 not in found  # no tokens
    stems = {(r.token, r.stem) for r in hmm.tag_and_stem(docs, m, Lexicon.seed(spark)).collect()}
    assert {("dogs", "dog"), ("walking", "walk"), ("stopped", "stopped")} & stems >= {("dogs", "dog")}


def test_long_texts_go_on_in_new_sequences(spark):
    docs = spark.createDataFrame([(1, "word " * 2500)], "doc_id long, text string")
    assert [(r["at"], len(r.tokens)) for r in hmm.sequences(docs).orderBy("at").collect()] == [(0, 1000), (1000, 1000), (2000, 500)]
    m = hmm.counted(hmm.sequences(docs), ["word"])
    rows = hmm.tagged(docs, m).agg(F.count("*").alias("n"), F.countDistinct("pos").alias("p"), F.max("pos").alias("m")).first()
    assert (rows.n, rows.p, rows.m) == (2500, 2500, 2499)


def test_long_sequences_are_decoded_like_by_a_plain_walk():
    m, r = model(7), np.random.default_rng(8)
    seqs = [r.integers(0, m.emission.shape[1], n) for n in (1, 1000, 0, 37, 300, *[5] * 300)]
    start, move, word = (np.array(x) for x in m.scores())
    move, word = move.reshape(3, 3), word.reshape(-1, 3)
    for seq, got in zip(seqs, hmm.best_paths(m.scores(), 3, seqs), strict=True):
        score, back = start + word[seq[0]] if len(seq) else start, []
        for s in seq[1:]:
            every = score[:, None] + move
            back.append(every.argmax(0))
            score = every.max(0) + word[s]
        path = [score.argmax()] if len(seq) else []
        for b in reversed(back):
            path.insert(0, b[path[0]])
        assert got.tolist() == path


def test_texts_are_tokenized_and_decoded_before_stems_are_joined(spark):
    docs = spark.createDataFrame([(1, "The dogs ran. It's big.")], "doc_id long, text string")
    made = hmm.tag_and_stem(docs, hmm.counted(hmm.sequences(docs), ["the"]), Lexicon.seed(spark))
    said = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in said and "ArrowEvalPython" not in said
    assert made.count() == 8
