"""Token counts through a digest cache.

A cache is a Parquet folder of (content_digest, tokenizer_digest, n_tokens). Texts are joined to it by the digest of
their normalised content and the digest of the tokenizer's file; only distinct contents that the cache lacks are
encoded, and their counts are appended. Copies of one content leave each scan task once, so a content that fills a
third of the table reaches the encoder as a few rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, discard, materialise, shared_dir, table, tidy

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
CACHE = T.StructType([T.StructField("content_digest", T.BinaryType()), T.StructField("tokenizer_digest", T.StringType()), T.StructField("n_tokens", T.LongType())])


class Counter:
    """Counts tokens as the tokenizers library does for the given definition: no truncation, no padding, no tokens added."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every digest that this task meets; what it keeps are digests only."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for d in batch.column(0).to_pylist():
            new.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(new, pa.bool_()))


def encoder(definition: bytes):
    version = hashlib.sha256(definition).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(definition)
        for batch in first_of_each(batches):
            for some in by_bytes(batch, 1):
                counts = counter(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=CACHE.names)

    return encode


def definition_of(name: str = TOKENIZER) -> bytes:
    """The public tokenizer's file, read once on the driver and sent with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The stored counts of this tokenizer version, or None if the folder isn't there yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version)


def count_tokens(docs: DataFrame, cache: str, definition: bytes, limit: int = LIMIT, normalise=lambda text: text) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, n_tokens, over_limit; the cache gains what it lacked.

    normalise must not change a text's count (the default leaves it as it is). A null text counts as an empty one: 0
    bytes, 0 tokens. Repeated rows and null ids stay rows of their own; an empty table gives no rows; a cache with
    a count stored twice (two writers at once) gives each row once; other columns are ignored. A very long text is
    encoded whole, in one piece.
    """
    spark = docs.sparkSession
    version = hashlib.sha256(definition).hexdigest()
    text = F.coalesce(F.col("text"), F.lit(""))
    digest: Column = F.unhex(F.sha2(normalise(text).cast("binary"), 256))
    stored = cached(spark, cache, version)
    distinct = docs.select(digest.alias("content_digest"), normalise(text).alias("text")).mapInArrow(tidy(first_of_each), "content_digest binary, text string")
    if stored is not None:
        distinct = distinct.join(stored.select("content_digest").distinct(), "content_digest", "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fresh = distinct.repartition(parts, "content_digest").mapInArrow(tidy(encoder(definition)), CACHE)
    fresh.write.mode("append").parquet(cache)
    # on its own, so that the join below reads plain exchanges, whose hot digests Spark can split
    counts = materialise(cached(spark, cache, version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens")), "token-counts")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("content_digest"))
    return rows.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run starts from an empty cache, so that it counts all texts itself."""
    cache = shared_dir(spark, "token-cache")
    out = count_tokens(table(spark, sf_dir, "documents"), cache, definition_of())
    discard(spark.read.schema(CACHE).parquet(cache))  # the result has a copy of the counts
    return out
