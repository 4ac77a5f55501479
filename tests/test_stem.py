import pytest

from verbaflow.functions.lexicon import Lexicon
from verbaflow.operators import stem


@pytest.fixture(scope="module")
def lexicon(spark):
    return Lexicon.seed(spark)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_the_seed_is_sent_to_the_words(spark, lexicon):
    """Spark knows that it is small, so that candidates are not shuffled to meet it."""
    for table in (lexicon.lemmas, lexicon.exceptions):
        assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000


def test_badness(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("see",), ("seed",), ("princess",), ("glass",), ("dog",)], "w string")
    assert [r.b for r in rows.select(stem.word_badness(F.col("w")).alias("b")).collect()] == [1, 4, -2, 1, 3]


def test_normalize_list(spark, lexicon):
    texts = ["the dog", "the", "big dogs", "The", "to", "", "to try it", "I can't. Avoid fragments."]
    found = {r.doc_id: r.lemmas for r in stem.normalize_list(docs(spark, *texts), lexicon).collect()}
    assert [found[i] for i in range(len(texts))] == [["dog"], ["the"], ["big", "dog"], ["The"], [], [""], ["try", "it"], ["i", "can", "not", "avoid", "fragment"]]


def test_normalize_joins_as_text(spark, lexicon):
    assert stem.normalize(docs(spark, "I can not"), lexicon).first().normalized == "i cannot"


def test_stems_by_tag(spark, lexicon):
    words = [("seed", "NN"), ("feed", None), ("was", None), ("was", "NN"), ("Women", "NN"), ("making", None), ("glasses", "NNS"), ("people", "x"), ("blorbs", None), ("installing", "VBG"), ("better", "JJ")]
    rows = stem.stems(spark.createDataFrame(words, "word string, tag string"), lexicon).collect()
    found = {(r.word, r.tag): r.stem for r in rows}
    assert [found[w] for w in words] == ["see", "feed", "be", "was", "woman", "make", "glass", "person", "blorbs", "install", "good"]


def test_tag_and_stem(spark, lexicon):
    rows = stem.tag_and_stem(docs(spark, "the big dogs", "the #big dog", "I can't. Avoid fragments."), lexicon, stem.baseline_tag).orderBy("doc_id", "pos").collect()
    said = [" ".join(f"{r.stem}/{r.tag}/{r.token}" for r in rows if r.doc_id == k) for k in range(3)]
    assert said[0] == "the/DT/the big/JJ/big dog/NNS/dogs"
    assert said[1] == "the/DT/the #/NN/# big/JJ/big dog/NN/dog"
    assert said[2] == "i/PRP/I can/MD/ca not/RB/n't ././. avoid/NNP/Avoid fragment/NNS/fragments ././."


def test_normalize_topic(spark, lexicon):
    topics = spark.createDataFrame([(1, "Big_Dogs_(animal)"), (2, "Dogs")], "topic_id long, topic string")
    assert sorted(map(tuple, stem.normalize_topic(topics, lexicon).collect())) == [(1, "big dog", "n/animal"), (2, "dog", None)]


def test_titles_of_one_key(spark, lexicon):
    """Words of one place: those of the title without disambiguation first, whatever the letters; the SQL on one thread gives the same."""
    topics = [(1, "the_cold_widgets_(ECONOMY)_x"), (1, "cold_widget"), (2, "the_small_rings_(LARGE)_x"), (2, "small_ring")]
    rows = stem.normalize_topic(spark.createDataFrame(topics, "topic_id long, topic string"), lexicon).collect()
    assert sorted({(r.topic_id, r.name) for r in rows}) == [(1, "cold widget cold widgets"), (2, "small ring small rings")]
