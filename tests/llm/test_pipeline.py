import os
import random

import pytest
import sentencepiece

import corpus_pipeline
from verbaflow.llm import decontamination, jaccard_join, secrets, sentencepiece_codec
from verbaflow.llm.common import materialise, table

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the shared tables aren't here")


def test_stages_take_effect(spark):
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert len(before) > sizes[0] > sizes[1] >= sizes[2] == sizes[3]
    found = jaccard_join.near_duplicates(docs.join(spark.createDataFrame([(i,) for i in before], "doc_id long"), "doc_id")).collect()
    # cutting passages out may make two texts alike after the copies went; nothing else does
    assert sum(r.doc_id != r.component_id for r in found) <= sizes[1] // 50
    assert not any(r.contaminated for r in decontamination.contamination(docs, table(spark, DIR, "benchmark")).collect())
    from pyspark.sql import functions as F

    spans = secrets.secret_spans(docs, F.col("source"), F.col("lang")).collect()
    assert all(r.n_assign + r.n_access + r.n_hex == 0 for r in spans)


def test_run(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    pieces = sentencepiece_codec.Pieces.load(sentencepiece_codec.model_path())
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert pieces.decode(r.ids) == (r.text or "").replace("▁", " ") and r.n_pieces == len(r.ids)


def test_empty_documents(spark):
    docs = table(spark, DIR, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0, name


def fixture(spark, path):
    """Documents with one planted case for each stage, and what each must come to."""
    rnd = random.Random(21)
    words = ["".join(rnd.choice("aeioulnrstmdp") for _ in range(rnd.randrange(3, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    clean = {i: prose(90) for i in range(60)}
    passage = " ".join(f"item{k}" for k in range(14))
    want = dict(clean)
    rows = dict(clean)
    for i in range(100, 140):
        rows[i] = prose(30) + " " + " ".join(rnd.choice(["scumbag", "idiotic", "worthless"]) for _ in range(4)) + " " + prose(30)
    rows[200], rows[201] = clean[3] + " more", clean[3]
    rows[7], want[7] = f"{clean[7]} {passage.upper()}! {clean[8][:200]}", f"{clean[7]} ! {clean[8][:200]}"
    rows[300] = f"{passage} of test"
    rows[9], want[9] = f"{clean[9]} password=abcdefghijkl0 end", f"{clean[9]} [SECRET] end"
    rows[10], want[10] = f"{clean[10]}\n  ▁spaced\ttext é", f"{clean[10]}\n  ▁spaced\ttext é"
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows.items()] + [(400, None, "en", "s0", 0), (401, "", None, None, 0)]
    want |= {400: None, 401: ""}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return want


def test_planted_cases_against_what_they_must_come_to(spark, tmp_path):
    want = fixture(spark, f"{tmp_path}")
    rows = corpus_pipeline.run(spark, f"{tmp_path}").collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    assert [r.doc_id for r in rows if r.ids != library.encode(r.text or "") or r.n_chars != len(r.text or "")] == []


def test_columns_of_other_names_pass_and_empty_tables_do_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, None, "k", 1, "s", 0.5), (3, "", "k", 1, "s", 0.5), (3, "", "k", 1, "s", 0.5), (1, "one text that stays", "k", 1, "s", 0.5), (2, "w " * 100_000 + "end", "k", 1, "s", 0.5), (None, "by none", "k", 1, "s", 0.5)]
    docs = spark.createDataFrame([(i, t, "en", "a", *more) for i, t, *more in rows], "doc_id long, text string, lang string, source string, __key string, comp int, __spans string, __severity double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{tmp_path}")
        assert out.columns[: len(docs.columns)] == docs.columns, name
        got = sorted(((r.doc_id or 0, r.text or "", r["__key"], r.comp, r["__spans"], r["__severity"]) for r in out.collect()), key=str)
        assert got == sorted(((i or 0, t or "", *more) for i, t, *more in rows), key=str), name
