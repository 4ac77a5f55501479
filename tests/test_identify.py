import math
import os
from collections import Counter

import pytest

from verbaflow.operators import identify

ROWS = [
    ("en", "The house by the river was old, and they thought that it would fall."), ("en", "There was nothing that the other people could do with this."),
    ("de", "Das Haus am Fluß war alt, und sie dachten, daß es einstürzen würde."), ("de", "Es gab nichts, was die anderen Leute damit machen könnten."),
    ("es", "La casa junto al río era vieja y pensaban que se caería pronto."), ("es", "No había nada que las otras personas pudieran hacer con esto."),
]


def cut(text):
    plain = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " " + " ".join(plain.split()) + " "
    return [plain[i : i + 3] for i in range(len(plain) - 2)]


def test_against_plain_version(spark):
    docs = spark.createDataFrame(ROWS + [(None, "no language here"), ("en", None)], "lang string, text string")
    asked = [(1, "the people of the house"), (2, "die Leute im alten Haus"), (3, "las personas de la casa"), (4, "123 !!"), (5, None), (6, ""), (7, "x" * 50), (7, "x" * 50), (None, "Es gab das")]
    found = identify.identified(spark.createDataFrame(asked, "id long, text string"), identify.trained(docs, most=200), "id").collect()
    counts = {lang: Counter(g for of, t in ROWS if of == lang for g in cut(t)) for lang in ("de", "en", "es")}
    every = sum(counts.values(), Counter())
    kept = [g for g, _ in sorted(every.items(), key=lambda x: (-x[1], x[0]))[:200]]
    below = {lang: sum(c[g] for g in kept) + len(kept) for lang, c in counts.items()}
    want = []
    for i, t in asked:
        gs = cut(t or "")
        scores = {lang: sum(math.floor(1000 * math.log(((c[g] if g in kept else 0) + 1) / below[lang]) + 0.5) for g in gs) for lang, c in counts.items()}
        best = min(scores, key=lambda lang: (-scores[lang], lang))
        want.append((i, len(gs), best if gs else None, scores[best] if gs else None))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert {r.id: r.guessed for r in found if r.id in (1, 2, 3)} == {1: "en", 2: "de", 3: "es"}


def test_nothing_known(spark):
    none = spark.createDataFrame([], "lang string, text string")
    rows = identify.identified(spark.createDataFrame([(1, "any text")], "id long, text string"), identify.trained(none), "id").collect()
    assert [(r.id, r.guessed) for r in rows] == [(1, None)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the shared tables aren't here")
def test_held_out_accuracy(spark):
    from verbaflow.plans import learned

    rows = learned.identify_language(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(rows) > 200 and sum(r.guessed == r.lang for r in rows) / len(rows) > 0.98


def test_trigrams_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(identify, "AT_ONCE", 40)
    monkeypatch.setattr(identify, "HELD", 5)
    docs = spark.createDataFrame(ROWS + [("en", None), ("en", "")], "lang string, text string")
    counts = identify.counted(docs)
    want = Counter((lang, g) for lang, t in ROWS for g in cut(t))
    assert {(r.lang, r.gram): r.n for r in counts.collect()} == want
    made = identify.identified(docs, identify.trained(docs), "lang")
    assert "Generate" not in counts._jdf.queryExecution().toString() + made._jdf.queryExecution().toString()
    assert all(r.guessed == r.lang for r in made.where("n_grams > 0").collect())
