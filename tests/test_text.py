import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbaflow.functions import text
from verbaflow.functions.tokenize import tokenize


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def one_list(spark, value, column):
    return spark.createDataFrame([(value,)], "x array<string>").select(column(F.col("x")).alias("y")).first().y


# Golden sentences and titles: results for these must stay as they are.
TIME = "Time is an illusion. Lunchtime, doubly so."
BAKER = '"Quite right," said Ada, "they can print that in next week\'s Gazette. They\'ve some room for letters from people here."'


def test_tokenize(spark):
    assert one(spark, TIME, tokenize) == ["Time", "is", "an", "illusion", ".", "Lunchtime", ",", "doubly", "so", "."]
    assert one(spark, "I can't. Avoid fragments.", tokenize) == ["I", "ca", "n't", ".", "Avoid", "fragments", "."]
    assert one(spark, "the #big dog", tokenize) == ["the", "#", "big", "dog"]
    assert one(spark, "", tokenize) == []
    assert one(spark, None, tokenize) is None


@pytest.mark.parametrize("given_text", [TIME, BAKER])
def test_round_trip(spark, given_text):
    assert one(spark, given_text, lambda c: text.untokenize(tokenize(c))) == given_text


def test_untokenize_does_not_overlap(spark):
    assert one_list(spark, ["a", ".", ",", "b"], text.untokenize) == "a. , b"
    assert one_list(spark, ["pelican", "nothing"], text.untokenize) == "pelicannothing"
    assert one_list(spark, ["i", "can", "not"], text.untokenize) == "i cannot"


@pytest.mark.parametrize(
    ("joined", "words"),
    [
        ("1984ZXSpectrumGames", "1984 ZX Spectrum Games"),
        ("aaAa aaAaA 0aA AAAa!AAA", "aa Aa aa Aa A 0a A AA Aa! AAA"),
        ("MotörHead", "Motör Head"),
        ("MSWindows3.11ForWorkgroups", "MS Windows 3.11 For Workgroups"),
        ("ACM_Computing_Classification_System", "ACM Computing Classification System"),
        ("Anne_Blunt,_15th_Baroness_Wentworth", "Anne Blunt, 15th Baroness Wentworth"),
        ("Hindi-Urdu", "Hindi-Urdu"),
        ("a - b", "a -b"),
    ],
)
def test_camel_case(spark, joined, words):
    assert one(spark, joined, text.un_camel_case) == words


def test_pieces(spark):
    found = one(spark, "12 12 12345 123456 1234567-12345678", lambda c: text.string_pieces(c, 6))
    assert found == ["12 12 ", "12345 ", "123456", " ", "123456", "7-", "123456", "78"]
    assert one(spark, "", text.string_pieces) == []
    with pytest.raises(ValueError):
        text.string_pieces(F.col("x"), 0)


@settings(max_examples=15, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x3000), max_size=60), st.integers(1, 9))
def test_pieces_join_to_the_text(spark, value, size):
    found = one(spark, value, lambda c: text.string_pieces(c, size))
    assert "".join(found) == value and all(0 < len(x) <= size for x in found)


@pytest.mark.parametrize(("value", "said"), [("word", False), ("。", True), ("-", True), ("-3", False), ("あ", False), ("", True)])
def test_punctuation(spark, value, said):
    assert one(spark, value, text.is_punctuation) is said


def test_punctuation_follows_unicode_classes(spark):
    chars = [c for c in map(chr, range(0x20, 0x250)) if unicodedata.category(c) != "Cn"]
    rows = spark.createDataFrame([(c,) for c in chars], "x string").select("x", text.is_punctuation(F.col("x")).alias("y")).collect()
    assert [r.x for r in rows if r.y != (unicodedata.category(r.x)[0] in "PSZMC")] == []


def test_render_safe(spark):
    assert one(spark, "a\x00b\nc\x7f\U00100001d", text.render_safe) == "ab\ncd"


@pytest.mark.parametrize(("topic", "name", "sense"), [("Foo_(bar_)", "Foo", "n/bar"), ("Foo (bar) baz", "Foo", "n/bar"), ("(bar)", "(bar)", None), ("Foo_bar", "Foo bar", None)])
def test_topic(spark, topic, name, sense):
    assert tuple(one(spark, topic, text.topic_parts)) == (name, sense)


def test_rules_go_over_texts_that_need_them(spark):
    """Texts with and without what a rule is about have the tokens that all rules in turn give."""
    from verbaflow.functions import tokenize as t

    assert len(t.NEEDS) == len(t.RULES)
    texts = ["Plain words, here: two. Then 3.5, and 1,000.", " a\n\tb. C", ". A", ",", "a,, 5:", "x,,,5", "(\"It's\" he said...", "CaNNot stop!", "a.\x01b.", "50% -- [Dr. Who]", "e.  ", "end.\x85", "", "It's,\nn't n't.", "été. Émile", None]
    whole = F.col("text")
    for pattern, new in t.RULES:
        whole = F.regexp_replace(whole, pattern, t._template(new, "$"))
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", t.tokenize(F.col("text")).alias("got"), F.filter(F.split(whole, " "), lambda x: x != "").alias("want"))
    for r in rows.collect():
        assert r.got == r.want, r.text
