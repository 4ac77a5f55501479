import pytest

from verbaflow.functions.tokenize import RULES
from verbaflow.plans import learned, registry, surface  # noqa: F401  all register queries

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["tokens_top", "tokens_long", "punct_tokens", "badness", "phrases_2", "records_norm", "records_tag_stem", "untok_roundtrip"])
def test_texts_are_tokenized_once(spark, name):
    assert plan(spark, name).count("regexp_replace") <= len(RULES) + 3  # and what joins tokens again


@pytest.mark.parametrize("name", ["freq_list", "freq_merge", "freq_log", "word_frequencies", "stem_words"])
def test_nothing_is_numbered_in_one_task(spark, name):
    said = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().toString()
    assert "SinglePartition" not in said


@pytest.mark.parametrize("name", ["stem_words_induced", "freq_translated", "suffix_signatures", "word_frequencies", "stem_words"])
def test_words_that_are_read_again_are_kept(spark, name):
    """No text is tokenized in the plan that reads them several times."""
    assert plan(spark, name).count("regexp_replace") == 0


@pytest.mark.parametrize(("name", "most"), [("records_norm", 2), ("records_tag_stem", 2), ("phrases_2", 2), ("is_stop_text", 3), ("records_mecab", 5)])
def test_lines_are_split_once(spark, name, most):
    """One split makes tokens, one the fields of a line; of MeCab lines one each for the two separators."""
    assert plan(spark, name).count("split(") <= most


def test_every_query_has_its_sql():
    """But for what is fitted in rounds."""
    assert registry.QUERIES.keys() - registry.ORACLE_SQL.keys() == {"tag_hmm"}
