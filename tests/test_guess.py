from collections import Counter

import pytest

from verbaflow.operators import guess

TAGS = ("NN", "VBG", "RB")
WORDS = [("walking", "VBG", 5), ("talking", "VBG", 3), ("king", "NN", 4), ("slowly", "RB", 2), ("fly", "NN", 1), ("dog", "NN", 9), ("a", "NN", 2), ("odd", "XX", 50)]


def plain(word, longest=6):
    counts = {}
    for w, t, n in WORDS:
        if t in TAGS:
            for k in range(min(longest, len(w)) + 1):
                counts.setdefault(w[len(w) - k :], Counter())[t] += n
    every = counts[""]
    p = [every[t] / sum(every.values()) for t in TAGS]
    weight = sum((x - 1 / 3) ** 2 for x in p) / 2
    for k in range(1, min(longest, len(word)) + 1):
        c = counts.get(word[len(word) - k :])
        if c:
            p = [(c[t] / sum(c.values()) + weight * old) / (1 + weight) for t, old in zip(TAGS, p, strict=True)]
    return sorted(((round(x * guess.PARTS), t) for x, t in zip(p, TAGS, strict=True) if x >= guess.LEAST), key=lambda x: (-x[0], TAGS.index(x[1])))


def test_against_plain_version(spark):
    endings = guess.learned(spark.createDataFrame(WORDS, "word string, tag string, n long"), TAGS)
    asked = ["jumping", "sing", "quickly", "cat", "x", "", "flying fish", "walking"]
    rows = spark.createDataFrame([(w, 1) for w in asked] + [(None, 1)], "word string, other int")
    got = {r.word: r.guesses for r in guess.guessed(rows, endings).collect()}
    for w in asked:
        assert [(pytest.approx(g.parts, abs=1), g.tag) for g in got[w]] == plain(w), w
    assert got[None] is None and len(got) == len(asked) + 1
    assert got["jumping"][0].tag == "VBG" and got["quickly"][0].tag == "RB" and got["cat"][0].tag == "NN"


def test_nothing_learned(spark):
    endings = guess.learned(spark.createDataFrame([], "word string, tag string, n long"), TAGS)
    assert [r.guesses for r in guess.guessed(spark.createDataFrame([("x",)], "word string"), endings).collect()] == [None]
