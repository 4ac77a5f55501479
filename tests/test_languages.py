import sys

import pytest

from verbaflow import languages
from verbaflow.functions.lexicon import Lexicon
from verbaflow.plans.registry import _STAND_INS
from verbaflow.sources import analyzer, freeling


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_english_by_stems(spark):
    docs = frame(spark, [("en", "the big dogs"), ("en", "the"), ("en", None), ("en", "the big dogs"), ("en", "")])
    english = languages.english(Lexicon.seed(spark))
    assert sorted((r.text or "", r.normalize_list) for r in english.normalize_list(docs).collect() if r.text) == [("the", ["the"]), ("the big dogs", ["big", "dog"]), ("the big dogs", ["big", "dog"])]
    said = {r.text: None if r.tag_and_stem is None else " ".join("/".join(t) for t in r.tag_and_stem) for r in english.tag_and_stem(docs).collect()}
    assert said == {"the big dogs": "the/DT/the big/JJ/big dog/NNS/dogs", "the": "the/DT/the", None: None, "": ""}
    assert {r.text: r.is_stopword for r in english.is_stopword(docs).collect()} == {"the big dogs": False, "the": True, None: None, "": True}
    assert english.normalize(docs).count() == 5


def test_languages_by_a_column(spark):
    docs = frame(spark, [("es", "perro un gato"), ("ja", "abc def"), ("xx", "other"), (None, "none"), ("en", "big dogs")])
    found = {"es": languages.by_freeling("es", _STAND_INS["freeling"]), "ja": languages.japanese(_STAND_INS["mecab"]), "en": languages.english(Lexicon.seed(spark))}
    for operation, want in (
        ("normalize", {"es": "perro gato", "ja": "cba fed", "xx": None, None: None, "en": "big dog"}),
        ("tokenize", {"es": "perro un gato", "ja": "abc def", "xx": None, None: None, "en": "big dogs"}),
        ("is_stopword", {"es": False, "ja": False, "xx": None, None: None, "en": False}),
    ):
        rows = languages.apply(docs, found, operation)
        assert rows.columns == ["lang", "text", operation]
        assert {r.lang: r[operation] for r in rows.collect()} == want
    assert [len(r.phrases) for r in found["es"].phrases(docs.where("lang = 'es'")).collect()] == [3]
    assert found["ja"].romanize(docs.where("lang = 'ja'")).first().romanize == "abc def"
    with pytest.raises(ValueError):
        languages.apply(docs, found, "translate")


def test_every_language_there_is():
    assert languages.all_languages().keys() == {*freeling.LANGUAGES, "ja"}


def test_own_configuration_reaches_the_process(spark):
    """A process that answers with what its configuration file says."""
    script = "import sys\nfor line in sys.stdin:\n    print(''.join(x for x in open(sys.argv[2]) if x.startswith('Lang')) + open(sys.argv[4]).readline(), flush=True)"
    protocol = analyzer.freeling("cy", command=(sys.executable, "-c", script))
    docs = frame(spark, [("cy", "a line")])
    assert analyzer.analyzed_by_freeling(docs, protocol).first().lines == ["Lang=en", "<General>"]
    with pytest.raises(ValueError):
        analyzer.freeling("xx")


def test_a_hung_process_is_given_up(spark):
    script = "import sys, time\nfor line in sys.stdin:\n    time.sleep(60)"
    process = analyzer.Process(analyzer.Protocol((sys.executable, "-c", script), "EOS", error=analyzer.MeCabError, patience=0.5), restarts=1)
    with pytest.raises(analyzer.MeCabError):
        process.ask(["x"])


def test_remote_lemmas(spark):
    calls = []

    def call(text):
        calls.append(text)
        if len(calls) == 1:
            raise OSError("busy")
        return [f"{w}|x" for w in text.split()]

    rows = analyzer.remote_lemmas(frame(spark, [("en", "a b"), ("en", None)]).coalesce(1), call, wait=0.01).collect()
    assert [r.lemmas for r in rows] == ["a b", None]


def test_one_pass_for_all_processes(spark):
    """Seven languages scan their table once; only English, which joins stems to tokens and lists to texts, scans it again."""
    spark.range(0).selectExpr("'es' AS lang", "'x' AS text").write.mode("overwrite").saveAsTable("language_docs")
    docs = spark.table("language_docs")
    scans = lambda found: languages.apply(docs, found, "normalize")._jdf.queryExecution().optimizedPlan().toString().count("Relation spark_catalog.default.language_docs")
    every = {code: languages.by_freeling(code, _STAND_INS["freeling"]) for code in freeling.LANGUAGES} | {"ja": languages.japanese(_STAND_INS["mecab"])}
    assert scans(every) == 1
    assert scans(every | {"en": languages.english(Lexicon.seed(spark))}) <= 6


NUMBERED = """
import sys, os
count = 0
for line in sys.stdin:
    count += 1
    line = line.strip()
    if line in sys.argv[1:] and not os.path.exists(line):
        open(line, "w").close()
        os._exit(1)
    print(line + " a")
    print(line + " b\\nEND", flush=True)
"""


def numbered(*crashes):
    return analyzer.Protocol((sys.executable, "-c", NUMBERED.replace("\\\\", "\\"), *crashes), "END")


@pytest.mark.parametrize("window", [1, 3, 64])
def test_answers_in_order_through_crashes(tmp_path, window):
    """Processes that end amid a window of lines on their way: no answer is lost, none comes twice."""
    lines = [str(tmp_path / f"line{i}") for i in range(200)]
    process = analyzer.Process(numbered(lines[5], lines[6], lines[7], lines[120]), restarts=2, window=window)
    assert process.ask_each(lines) == [[f"{x} a", f"{x} b"] for x in lines]
    assert process.ask([]) == []
    process.close()


def test_a_line_that_ends_every_process_fails():
    script = "import sys\nfor line in sys.stdin:\n    line == 'bad\\n' and sys.exit(1)\n    print('ok\\nEND', flush=True)"
    process = analyzer.Process(analyzer.Protocol((sys.executable, "-c", script), "END", error=analyzer.MeCabError), restarts=2)
    assert process.ask_each(["a"] * 5) == [["ok"]] * 5
    with pytest.raises(analyzer.MeCabError):
        process.ask_each(["a"] * 5 + ["bad"] + ["a"] * 5)
    process.close()


def test_lines_on_their_way_save_time():
    """A process that answers 20 ms after each line, however many wait: together they take less than one by one."""
    script = """
import sys, threading, queue, time
q = queue.Queue()
def answer():
    while (x := q.get()) is not None:
        time.sleep(max(0, x[0] + 0.02 - time.monotonic()))
        print(x[1] + "END", flush=True)
t = threading.Thread(target=answer); t.start()
for line in sys.stdin:
    q.put((time.monotonic(), line))
q.put(None)
"""
    import time

    took = {}
    for window in (1, 64):
        process = analyzer.Process(analyzer.Protocol((sys.executable, "-c", script), "END"), window=window)
        process.ask_each(["warm"])
        began = time.monotonic()
        assert process.ask_each([str(i) for i in range(100)]) == [[str(i)] for i in range(100)]
        took[window] = time.monotonic() - began
        process.close()
    assert took[64] < took[1] / 4
