"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

Rows of documents pass from stage to stage with their own columns, whatever those are called; the last stage adds ids
and n_pieces, the encoded text, in place of columns of these names. Null and empty texts pass all stages and have no
pieces. Of repeated rows one stays; rows without an id go as near copies only of a row with one. Very long texts are worked
on whole. An empty table of documents gives no rows; without labels nothing counts as toxic, without benchmark items
nothing is cut. The pipeline is an application: each stage bounds the bytes of the session's Arrow batches, if they are at
Spark's default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbaflow.llm import decontamination, jaccard_join, secrets, sentencepiece_codec, toxicity
from verbaflow.llm.common import bound_batches, materialise, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the limit; the model learns from a sample of the labelled ones among them."""
    bound_batches(spark)
    return toxicity.accepted(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id; groups without any id and texts without words stay."""
    bound_batches(spark)
    return jaccard_join.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of texts, until none is left; documents that are little else go."""
    bound_batches(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    bound_batches(spark)
    return secrets.redacted(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids, the pieces of their texts, and n_pieces."""
    bound_batches(spark)
    return sentencepiece_codec.encoded(docs, sentencepiece_codec.Pieces.load(sentencepiece_codec.model_path()))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmarks),
    ("secret_scans", without_secrets),
    ("sentencepiece", as_pieces),
]
#: Fitted models, components and merges are beyond SQL; the tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
