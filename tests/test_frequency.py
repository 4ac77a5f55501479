from pyspark.sql import functions as F

from verbaflow.functions import frequency
from verbaflow.sources import analyzer


def test_lists(spark, tmp_path):
    path = tmp_path / "list.num"
    path.write_text("The frequency distribution for attribute\nFor more\n - corpus size: 3 tokens\n - lexicon size: 2 types\n1 30.50 Der\n2 20.25 der\n3 1.00 x\n")
    words = frequency.read_list(spark, str(path))
    assert [(r.rank, str(r.freq), r.word) for r in words.orderBy("rank").collect()] == [(1, "30.50", "Der"), (2, "20.25", "der"), (3, "1.00", "x")]
    low = {r.word: float(r.freq) for r in frequency.renormalized(words, F.lower).collect()}
    assert low == {"der": 50.75, "x": 1.0}
    both = {r.word: r.freq for r in frequency.merged([(words, 100.0), (spark.createDataFrame([("x", 1.0)], "word string, freq double"), 100.0)]).collect()}
    assert abs(sum(both.values()) - 200) < 1e-9 and both["x"] > 100
    assert abs(frequency.average(words).first()["mean"] - 51.75 / 3) < 1e-9
    asked = spark.createDataFrame([("x",), ("y",)], "word string")
    assert {r.word: r.freq for r in frequency.word_frequency(asked, words, 0.5).collect()} == {"x": 1.0, "y": 0.5}
    frequency.save(words, str(tmp_path / "out"))
    frequency.save_logarithmic(words, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), sep="\t").where("_c0 = 'x'").first()._c1 in ("0.0", "0")


def test_lists_translated_with_a_memory(spark, tmp_path):
    words = spark.createDataFrame([("en", "dogs", 2.0), ("en", "dog", 3.0), ("xx", "dogs", 5.0), ("en", "odd", 1.0)], "lang string, word string, freq double")
    asked = []

    def analyze(rows):
        some = sorted(r.word for r in rows.collect())
        asked.append(some)
        return rows.sparkSession.createDataFrame([(w, "dog" if w.startswith("dog") else None) for w in some], "word string, lemma string")

    want = {("en", "dog", 5.0), ("xx", "dog", 5.0), ("en", "odd", 1.0)}
    assert {tuple(r) for r in frequency.translated(words, analyze, "lang").collect()} == want
    memory = f"{tmp_path}/memory"
    for _ in range(2):
        assert {tuple(r) for r in frequency.translated(words, analyze, "lang", memory=memory).collect()} == want
    assert asked == [["dog", "dogs", "odd"]] * 2 + [[]]


def test_words_are_asked_at_a_bounded_rate(spark):
    import time

    words = spark.createDataFrame([(f"w{i}",) for i in range(20)], "word string")
    began = time.monotonic()
    rows = analyzer.asked_words(words, lambda w: [w.upper() + "|x|y"], at_once=2, per_second=10).collect()
    assert {r.word: r.lemma for r in rows} == {f"w{i}": f"W{i}|x" for i in range(20)}
    assert time.monotonic() - began > 1.0  # the fuller of two tasks has ten words or more, at five a second
