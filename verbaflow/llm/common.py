"""What the operators of this package share: table access, shared storage, code shipping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need no copy of this package: functions defined in it travel by value.
cloudpickle.register_pickle_by_value(sys.modules["verbaflow.llm"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees. Where that is unset, a temporary one if all of
    Spark is in this process; on a cluster that would be lost or not be found, so it fails there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _alone(spark.sparkContext.master)
    return f"{base.rstrip('/')}/verbaflow/{label}-{uuid.uuid4().hex}"


def _alone(master: str, made: list[str] = []) -> str:  # noqa: B006  one folder for the process
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder; set it to one that the driver and all executors share")
    if not made:
        made.append("file://" + tempfile.mkdtemp(prefix="verbaflow-"))
    return made[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back. Python functions get batches of FEW_BYTES."""
    path = shared_dir(df.sparkSession, label)
    with few_bytes(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drawn(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows of df, the ones whose keys' hashes are least; keys are distinct. A threshold on the hash leaves about
    twice as many before they are sorted, so that what meets in one task follows n and not the table."""
    total = df.count()
    if total > 2 * n:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < max(1, int(2 * n / total * (1 << 30))))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(n)


def discard(*tables: DataFrame) -> None:
    """Removes materialised tables that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            delete(df.sparkSession, file.rpartition("/")[0])


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared storage, wherever Spark keeps it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bytes of text that a Python function works on at once.
AT_ONCE = 2 << 20


def by_bytes(batch: pa.RecordBatch, column: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most `most` bytes in a column of texts; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        before = int(size[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def release() -> None:
    """Gives memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What bounds a batch that Spark hands to a Python function, and our value where the session has Spark's own: the JVM and the
#: worker hold a batch several times over.
BATCH_BYTES, DEFAULT_BYTES, FEW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def bound_batches(spark: SparkSession) -> None:
    """For applications: batches of the session are FEW_BYTES from now on, if it has Spark's default."""
    if spark.conf.get(BATCH_BYTES) == DEFAULT_BYTES:
        spark.conf.set(BATCH_BYTES, FEW_BYTES)


@contextlib.contextmanager
def few_bytes(spark: SparkSession) -> Iterator[None]:
    """Batches are FEW_BYTES while this lasts; then the session is as it was."""
    before = spark.conf.get(BATCH_BYTES)
    bound_batches(spark)
    try:
        yield
    finally:
        if spark.conf.get(BATCH_BYTES) != before:
            spark.conf.set(BATCH_BYTES, before)


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """function over batches, which leaves no memory behind in a worker that is used again."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            release()

    return run
