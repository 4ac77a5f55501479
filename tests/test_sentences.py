import math
import re

import pytest
from pyspark.sql import functions as F

from verbaflow.functions.tokenize import tokenize
from verbaflow.operators import sentences as s

TEXTS = [
    "Mr. Smith met Mrs. Jones. They spoke with Dr. Brown about the house. It was late.",
    "The house of Mr. Brown is old. Mrs. Brown says so. She knows, e.g. from Dr. Jones.",
    "J. R. Smith lives there. He is at home. Dr. Smith is not at home, says Mr. Jones.",
    "We saw the house. They saw it. It is what Mr. Smith said. Mrs. Smith left. He said it was late.",
    "Did he go? Yes! \"He did.\" The home of Mrs. Jones is near, i.e. not far. Mr. Brown came in.",
    "It was the house, e.g. of Mr. Jones. The old man, i.e. Dr. Brown. They left, he said, and she came. We came.",
] * 3 + [
    f"{a} house and home of it were old and late, so Smith and Jones and Brown went far in; he said so near there, left it at home, came there and so late in old time, far and near."
    for a in ("The", "This", "That", "One") * 5
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, "en", t) for i, t in enumerate(TEXTS)] + [(100, "en", None), (101, "en", ""), (102, "en", " \n "), (103, None, "Mr. Smith left."), (104, "de", "Das Haus. Der Baum.")], "id long, lang string, text string")


def test_abbreviations(docs):
    words = s.word_statistics(docs)
    found = {r.form: r for r in s.abbreviations(words).where("lang = 'en'").collect()}
    assert {"mr", "mrs", "dr", "e.g", "i.e"} <= set(found)
    assert not {"house", "late", "so", "home", "it", "smith", "jones"} & set(found)
    # by hand
    tokens = [w for t in TEXTS for w in (re.sub(r"^[^a-zA-Z0-9]+|[^a-zA-Z0-9.]+$", "", x) for x in t.split()) if w]
    n, k = len(tokens), sum(w.endswith(".") for w in tokens)
    of = [w for w in tokens if w.lower().removesuffix(".") == "mr"]
    a, b = len(of), sum(w.endswith(".") for w in of)
    ratio = 2 * (b * math.log(0.99) + (a - b) * math.log(0.01) - b * math.log(k / n) - (a - b) * math.log(1 + 1e-8 - k / n))
    assert (found["mr"].n, found["mr"].n_period) == (a, b)
    assert found["mr"].score == pytest.approx(ratio * math.exp(-2) * 2.0 ** (b - a))


def test_sentences(docs):
    got = {r.id: r.sentences for r in s.sentences(docs, "id").collect()}
    assert got[0] == ["Mr. Smith met Mrs. Jones.", "They spoke with Dr. Brown about the house.", "It was late."]
    assert got[2] == ["J. R. Smith lives there.", "He is at home.", "Dr. Smith is not at home, says Mr. Jones."]
    assert got[4][:3] == ["Did he go?", "Yes!", "\"He did.\""]
    assert got[100] is None and got[101] == [] and got[102] == []
    assert got[103] == ["Mr.", "Smith left."]  # no language, nothing learned
    assert got[104] == ["Das Haus.", "Der Baum."]


def test_a_sentence_may_end_with_an_abbreviation(spark):
    """`They` is written in lower case and never with a capital inside: it begins a sentence after `etc.` too."""
    texts = ["We had tea, milk etc. They had none.", "They left and they came. So did they.", "Tea etc. is here, and milk etc. is there, cups etc. too."] * 4
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "id long, lang string, text string")
    got = {r.id: r.sentences for r in s.sentences(docs, "id", s.word_statistics(docs), least=0.05).collect()}
    assert got[0] == ["We had tea, milk etc.", "They had none."]


def test_gaps_and_marks_stay_out(spark):
    docs = spark.createDataFrame([(1, "en", "One\x01 here.\n\n Two  there.\t(Three.) Four")], "id long, lang string, text string")
    assert s.sentences(docs, "id").first().sentences == ["One here.", "Two  there.", "(Three.)", "Four"]


def test_tokens_with_abbreviations(spark):
    one = lambda text, *known: spark.range(1).select(tokenize(F.lit(text), known).alias("t")).first().t
    assert one("Mr. Smith left. He ran.", "mr", "dr") == ["Mr.", "Smith", "left", ".", "He", "ran", "."]
    assert one("Mr. Smith left. He ran.") == ["Mr", ".", "Smith", "left", ".", "He", "ran", "."]
    assert one("By Dr.", "dr") == ["By", "Dr", "."]  # the end of a text is one of a sentence
    assert one("He said e.g. This. Admr. Smith ran.", "e.g", "mr") == ["He", "said", "e.g.", "This", ".", "Admr", ".", "Smith", "ran", "."]


def test_plans(spark, docs):
    """Statistics are added up before they are shuffled, and texts move once, to meet their false ends."""
    words = s.word_statistics(docs)
    said = words._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in said and "Window" not in said
    cut = s.sentences(docs, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert cut.count("LogicalRDD") <= 2  # once for the ends, once for what is cut there; words are counted before


def test_words_begin_sentences_by_what_stands_before_them(spark):
    """Blanks of all kinds, at the ends too; the first word of a text begins one."""
    texts = ["\n Ab said.\t\x0bHe (so)! \"Yes.\") Ab He\r\n", "Ab ... He .) x", "He", " ", None, "x.He He"]
    rows = s.word_statistics(spark.createDataFrame([("en", t) for t in texts], "lang string, text string")).collect()
    assert {r.form: (r.n, r.n_period, r.n_lower, r.n_upper_inside) for r in rows} == {
        "ab": (3, 0, 0, 0), "said": (1, 1, 1, 0), "he": (5, 0, 0, 2), "so": (1, 0, 1, 0), "yes": (1, 1, 0, 0), "x": (1, 0, 1, 0), "x.he": (1, 0, 1, 0)}
