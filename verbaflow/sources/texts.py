"""Sources of texts: any of Spark's formats, as a table or as a stream, with a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of a table, as Spark estimates them, up to which it is dealt over all cores.
SMALL = 256 << 20


def read_texts(spark: SparkSession, path: str, kind: str = "parquet", column: str = "text", **options) -> DataFrame:
    """A table of texts; the named column is called text, all others keep their names."""
    df = spark.read.format(kind).options(**options).load(path)
    column = "value" if kind == "text" else column
    return df.withColumnRenamed(column, "text") if column != "text" else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is small; else as it is, without a shuffle. A small table may be one unsplittable
    block of a file, which one core would work through; beyond SMALL the scan itself has enough parts."""
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


def stream_texts(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_at_once: int = 16) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_at_once).load(path)
