import sys

import pytest
from pyspark.sql import functions as F

from verbaflow.functions import kana
from verbaflow.operators import records
from verbaflow.plans.registry import _MECAB, KANA_WORDS
from verbaflow.sources import analyzer, config, texts
from verbaflow.streaming import texts as streaming


def lines(spark, *rows):
    return spark.createDataFrame([(list(rows),)], "lines array<string>")


def test_mecab(spark):
    df = lines(spark, *(f"{s}\t{f}" for s, f in _MECAB)).select(records.from_mecab(F.col("lines")).alias("r"))
    row = df.select(records.normalized(F.col("r")).alias("n"), records.triples(F.col("r")).alias("t"), records.all_stop(F.col("r")).alias("s")).first()
    assert row.n == "テスト" and row.s is False
    assert " ".join("/".join(t) for t in row.t) == "これ/~名詞/これ は/~助詞/は テスト/名詞/テスト です/~助動詞/です 。/./。"


def test_mecab_odd_records(spark):
    df = lines(spark, "ん\t助動詞,*,*,*,不変化型,基本形,ん,ン,ン", "foo\t名詞,一般,*,*,*,*,*", "x\t名詞").select(records.from_mecab(F.col("lines")).alias("r"))
    found = df.first().r
    assert [(x.root, x.is_stop, x.reading) for x in found] == [("ない", False, "ン"), ("foo", False, None), ("x", False, None)]
    none = lines(spark, "は\t助詞,係助詞").select(records.from_mecab(F.col("lines"), stopwords=False).alias("r")).first().r
    assert none[0].is_stop is False


def test_freeling(spark):
    rows = ["¿ ¿ Fia 1", "Dónde dónde PT00000 1", "está estar VMIP3S0 0.9", "mi mi DP1CSS 1", "búfalo búfalo NCMS000 1", "? ? Fit 1"]
    df = lines(spark, *rows).select(records.from_freeling(F.col("lines"), F.lit("es")).alias("r"))
    said = df.select(records.triples(F.col("r")).alias("t")).first().t
    assert " ".join("/".join(t) for t in said) == "¿/./¿ dónde/P/Dónde estar/V/está mi/D/mi búfalo/N/búfalo ?/./?"
    full = lines(spark, "Dogs Dog NNS 0.5").select(records.from_freeling(F.col("lines"), F.lit("en")).alias("r")).first().r[0]
    assert (full.root, full.tag) == ("dog", "NNS")


def test_normalize_falls_back_to_tokens(spark):
    df = lines(spark, "The the DT 1").select(records.from_freeling(F.col("lines"), F.lit("en")).alias("r"))
    assert df.select(records.normalized_list(F.col("r")).alias("n")).first().n == ["The"]
    empty = lines(spark).select(records.from_freeling(F.col("lines"), F.lit("en")).alias("r"))
    assert tuple(empty.select(records.normalized_list(F.col("r")).alias("n"), records.all_stop(F.col("r")), records.phrases(F.col("r"))).first()) == ([], True, [])


def test_phrases(spark):
    rows = ["A a NN 1", "x x DT 1", "B b NN 1", "C c NN 1"]
    df = lines(spark, *rows).select(records.phrases(records.from_freeling(F.col("lines"), F.lit("en"))).alias("p"))
    assert [tuple(p) for p in df.first().p] == [("a", "A"), ("a b", "AxB"), ("b", "B"), ("b c", "BC"), ("c", "C")]


def test_lemma_of_a_remote_analyzer(spark):
    df = spark.createDataFrame([("go|VERB",), ("a|b|c",), ("plain",)], "x string")
    assert [r[0] for r in df.select(records.lemma_without_source(F.col("x"))).collect()] == ["go", "a|b", "plain"]


def test_romanize(spark):
    df = spark.createDataFrame(KANA_WORDS, "kana string, roman string")
    assert [tuple(r) for r in df.select("kana", kana.romanize(F.col("kana"))).collect()] == KANA_WORDS


def test_romanize_column(spark):
    df = spark.createDataFrame([("フジ",), ("「ア」。",), (None,), ("",), ("exact abc",), ("ン",), ("カ x ッ",)], "k string")
    assert [r[0] for r in df.select(kana.romanize(F.col("k"))).collect()] == ["fuji", "``a''.", None, "", "act abc", "n", "ka x t"]
    assert df.select(kana.romanize(F.col("k"), respell=None)).first()[0] == "huzi"
    assert df.select(kana.romanize(F.col("k"), respell=F.upper)).collect()[4][0] == "EXACT ABC"
    assert df.select(kana.respell_hepburn(F.lit("tya"))).first()[0] == "cha"
    assert df.select(kana.roman_punctuation(F.lit("ア・イ？"))).first()[0] == "ア.イ?"
    plan = df.select(kana.romanize(F.col("k")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_kana_table(spark):
    rows = {r.ch: (r.roman, r.cls) for r in kana.kana_table(spark).collect()}
    assert rows["ッ"] == ("t", kana.SMALL_TSU) and rows["ゃ"] == ("xya", kana.SMALL_Y) and rows["ー"] == ("_", kana.PROLONG) and rows["゠"] == ("hyphen", kana.KANA)


FAKE = """
import sys
for n, line in enumerate(sys.stdin):
    line = line.rstrip("\\n")
    if line == "die":
        sys.exit(1)
    for w in line.split():
        print(w + "\\tnoun," + str(len(w)))
    print("EOS", flush=True)
"""


def test_process_analyzer(spark, tmp_path):
    script = tmp_path / "fake.py"
    script.write_text(FAKE)
    protocol = analyzer.Protocol((sys.executable, str(script)), "EOS")
    df = spark.createDataFrame([(1, "Ab cd\nef"), (2, None), (3, "")], "doc_id long, text string")
    found = {r.doc_id: r.lines for r in analyzer.analyzed_by_mecab(df, protocol).collect()}
    assert found == {1: ["ab\tnoun,2", "cd\tnoun,2", "ef\tnoun,2"], 2: None, 3: []}
    process = analyzer.Process(protocol, restarts=2)
    with pytest.raises(analyzer.ProcessError):
        process.ask(["die"])
    assert process.ask(["x"]) == ["x\tnoun,1"]
    process.close()


def test_process_that_is_not_there():
    with pytest.raises(analyzer.ProcessError, match="installed"):
        analyzer.Process(analyzer.mecab(("/no/such/mecab",))).ask(["x"])
    assert analyzer.freeling("pt", "/conf").command == ("analyze", "-f", "/conf/pt.cfg", "--fsplit", "/conf/generic_splitter.dat")
    with pytest.raises(ValueError):
        analyzer.freeling("xx", "/conf")


def test_retries():
    left = [2]

    def call():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return "done"

    assert analyzer.with_retries(call, wait=0.001)() == "done"


def test_configs(spark, tmp_path):
    (tmp_path / "x.cfg").write_text("## comment\nLang=en\n\n#Off=1\nTagger = hmm \n")
    assert sorted(map(tuple, config.read_settings(spark, str(tmp_path / "x.cfg")).collect())) == [("Lang", "en"), ("Tagger", "hmm")]
    (tmp_path / "s.dat").write_text("<General>\nMaxWords 1000\n</General>\n<Markers>\n( )\n{ }\n</Markers>\n<SentenceEnd>\n</SentenceEnd>\n")
    assert sorted(map(tuple, config.read_sections(spark, str(tmp_path / "s.dat")).collect())) == [("General", 0, "MaxWords 1000"), ("Markers", 0, "( )"), ("Markers", 1, "{ }")]


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "Big dogs"), ("2024-01-01 00:02:00", "big cats")]
    spark.createDataFrame(rows, "at string, text string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    stream = texts.stream_texts(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    assert texts.read_texts(spark, str(tmp_path / "in")).count() == 2
    query = streaming.windowed_counts(stream, F.col("at")).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.word, r.n) for r in spark.table("counts").collect()) == [("big", 2), ("cats", 1), ("dogs", 1)]
    done = streaming.write_available(stream.select("text"), str(tmp_path / "out"), str(tmp_path / "ck"))
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_marks_are_told_once(spark):
    rows = spark.createDataFrame([([("a", "b", "NN", False, None, None), ("!", "x", "NN", False, None, None)],)], f"r {records.RECORDS}").select(records.triples(F.col("r")).alias("t"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1
    assert [tuple(t) for t in rows.first().t] == [("b", "NN", "a"), ("!", ".", "!")]
