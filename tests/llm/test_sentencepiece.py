import hashlib
import os
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from verbaflow.llm import sentencepiece_codec as c

ODD = ["", "a  b", "  a", "a\nb", "\ta ", " ", "\xa0x", "é́ ﬁ", "a\x00b", "<s>hi</s><unk><0x0A>", "▁x", "=" * 40, "x" * 5000, "日本 한국 😀", "MERCHANTABILITY representation"]


@pytest.fixture(scope="module")
def pieces():
    return c.Pieces.load(c.model_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=c.model_path())


def test_merge_as_the_library(pieces, library):
    rnd = random.Random(1)
    encoder = c.Encoder(pieces, {c.named(w): c.packed(pieces.merged(w)) for w in ("▁a", "▁", "b", "▁▁", "▁the", "▁.", "▁▁a")}, c.Merger(pieces))
    texts = ODD + ["".join(rnd.choice("  abcdeth\n.é▁-=*0梦\x00𝒳\t/") for _ in range(rnd.randrange(60))) for _ in range(400)]
    for x, packed in zip(texts, encoder(texts), strict=True):
        ids = np.frombuffer(packed, np.int32).tolist()
        assert ids == library.encode(x) and pieces.decode(ids) == library.decode(ids)
    for word in ["▁" + "anana" * 6, "▁▁▁▁▁", "=" * 30]:
        assert pieces._merged_long(word) == pieces.merged(word)
    assert encoder([None, ""]) == [b"", b""]


def test_merging_side_by_side(pieces):
    rnd = random.Random(9)
    words = {"▁" * rnd.randrange(3) + "".join(rnd.choice("abcdeestaoinhr.é梦-A") for _ in range(rnd.randrange(1, 20))) for _ in range(3000)} - {""}
    got = c.Merger(pieces).merged(list(words))
    assert got.keys() == words and all(np.frombuffer(ids, "<i4").tolist() == pieces.merged(w) for w, ids in got.items())


def test_lattice_fold_as_the_library(spark, pieces, library):
    words = ["▁the", "▁representation", "▁x梦😀y", "▁▁▁", "ab", "▁" + "na" * 12, "▁<0x0A>"]
    rows = c.word_codes(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()
    assert {r.word: r.ids for r in rows} == {w: pieces.merged(w) for w in words}
    assert pieces.merged("▁representation") == library.encode("representation")


def best_path(word, pieces, unknown_score):
    best = [(0.0, [])] + [None] * len(word)
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + pieces.scores[word[i:j]], best[i][1] + [pieces.ids[word[i:j]]]) for i in range(j) if word[i:j] in pieces.scores]
        if word[j - 1] not in pieces.scores:
            options.append((best[j - 1][0] + unknown_score, best[j - 1][1] + [pieces.unknown]))
        best[j] = max(options, key=lambda o: o[0])
    return best[-1]


def test_viterbi_fold(spark):
    rnd = random.Random(4)
    names = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4))) for _ in range(14)} | {"a", "b"}
    names = sorted(names)
    small = c.Pieces({p: i + 1 for i, p in enumerate(names)}, {p: -rnd.uniform(1, 9) for p in names}, None, 0, ["?"] * 30, 3)
    words = sorted({"".join(rnd.choice("abcz") for _ in range(rnd.randrange(1, 12))) for _ in range(40)})
    got = {r.word: r.ids for r in c.word_codes(spark.createDataFrame([(w,) for w in words], "word string"), small, "viterbi").collect()}
    lost = min(small.scores.values()) - c.UNKNOWN_PENALTY
    assert got == {w: best_path(w, small, lost)[1] for w in words}


def frame(spark, texts):
    return spark.createDataFrame([(i, x, "q") for i, x in enumerate(texts)], "doc_id long, text string, ids string")


@pytest.mark.parametrize("frequent", [3, 1000])
def test_round_trip(spark, pieces, library, frequent):
    texts = [*ODD, None, "the the of the"]
    rows = c.encoded(frame(spark, texts), pieces, frequent)
    out = {r.doc_id: r for r in c.decoded(rows, pieces).collect()}
    for i, x in enumerate(texts):
        assert out[i].ids == library.encode(x or "") and out[i].n_pieces == len(out[i].ids)
        assert out[i].decoded == (x or "").replace("▁", " ")
    assert all(r.restored for r in c.coded(frame(spark, texts), pieces, frequent).collect())


def test_empty(spark, pieces):
    assert c.encoded(frame(spark, []), pieces).collect() == []
    assert c.word_counts(spark.createDataFrame([(1, "a b a")], "doc_id long, text string")).where(F.col("word") == "▁a").first().n == 2


def test_null_ids_repeated_rows_and_clashing_columns(spark, pieces, library):
    rows = spark.createDataFrame([(None, "a b", "x"), (None, "a b", "x"), (2, None, None)], "doc_id long, text string, decoded string")
    out = c.decoded(c.encoded(rows, pieces), pieces)
    assert out.columns == ["doc_id", "text", "ids", "n_pieces", "decoded"]
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in out.collect()) == [(0, library.encode("a b"), "a b")] * 2 + [(2, [], "")]
    assert sorted((r.doc_id or 0, r.n_pieces) for r in c.coded(rows, pieces).collect()) == [(0, 2), (0, 2), (2, 0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the shared tables aren't here")
def test_the_query_as_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    ids = [np.array(library.encode(r.text or ""), "<i4") for r in docs]
    want = sorted((r.doc_id, len(i), hashlib.sha256(i.tobytes()).hexdigest(), True) for r, i in zip(docs, ids, strict=True))
    assert sorted(map(tuple, c.op4_sentencepiece(spark, "/root/testdata/sf0.001").collect())) == want
