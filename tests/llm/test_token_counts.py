import os

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from verbaflow.llm import token_counts as t
from verbaflow.llm.common import shared_dir

TEXTS = ["", "Hello, world!", "  two   spaces\n\n\t", "a<|endoftext|>b <|endoftext|>", "naïve ÀÉÎ über", "日本語 ひらがな 한국어", "x" * 3000, "12345 67,8", "don't we'll I'M", "𝒳 é\u0301 \u00a0\u2003z", "ſǅ Ɂɏ ɐ", " " * 500 + "z", "\x00\x01", "a\r\nb", "😀👍🏽"]


@pytest.fixture(scope="module")
def definition():
    return t.definition_of()


def library(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(t.TOKENIZER))
    return [len(e) for e in tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_as_the_library(definition):
    long = ["word " * 400_000, "y" * 100_000]
    assert t.Counter(definition)(TEXTS + long) == library(TEXTS + long)


def test_cache(spark, definition):
    rows = [(i, x, "x", 1) for i, x in enumerate(TEXTS)] + [(100, None, "x", 1), (None, TEXTS[1], "x", 1), (1, TEXTS[1], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, content_digest int")
    cache = shared_dir(spark, "test-cache")
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, len((x or "").encode()), n, n > t.LIMIT) for (i, x, *_), n in zip(rows, library([r[1] for r in rows]), strict=True)), key=key)
    got = sorted(map(tuple, t.count_tokens(df, cache, definition).collect()), key=key)
    assert got == want
    stored = spark.read.parquet(cache).count()
    assert stored == len(set(x or "" for _, x, *_ in rows))  # null is the empty text
    assert sorted(map(tuple, t.count_tokens(df, cache, definition).collect()), key=key) == want
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again
    more = spark.createDataFrame([(7, "something new")], "doc_id long, text string")
    assert t.count_tokens(more, cache, definition).count() == 1 and spark.read.parquet(cache).count() == stored + 1


def test_empty(spark, definition):
    assert t.count_tokens(spark.createDataFrame([], "doc_id long, text string"), shared_dir(spark, "test-cache"), definition).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the shared tables aren't here")
def test_the_query_as_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(docs, library([r.text for r in docs]), strict=True))
    assert sorted(map(tuple, t.op2_token_counts(spark, "/root/testdata/sf0.001").collect())) == want
