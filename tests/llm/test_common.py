import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verbaflow.llm import common


@pytest.mark.parametrize("kind", [pa.string(), pa.binary()])
def test_slices_of_bounded_bytes(kind):
    texts = ["a" * n for n in (3, 0, 9, 30, 1, 1, 1)] + [None, "b" * 4]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, kind)], names=["i", "text"])
    parts = [some.column(0).to_pylist() for some in common.by_bytes(batch, 1, 10)]
    assert [i for p in parts for i in p] == list(range(len(texts)))
    assert all(len(p) == 1 or sum(len(texts[i] or "") for i in p) <= 10 for p in parts) and len(parts) == 4
    assert list(common.by_bytes(batch.slice(0, 0), 1)) == []


def test_shared_folder(spark):
    assert common.shared_dir(spark, "x") != common.shared_dir(spark, "x")
    with pytest.raises(ValueError):
        common._alone("spark://host:7077")


def test_names_that_are_free(spark):
    df = spark.createDataFrame([(1, 2)], "__key int, __KEY2 int")
    assert (common.unused(df, "__key"), common.unused(df, "__key2"), common.unused(df, "x")) == ("___key", "___key2", "x")


def batch_rows(df):
    """How many rows a Python function gets at once."""
    return df.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")


def test_batches_are_bounded_in_a_session_that_never_set_the_key(spark):
    fresh = spark.newSession()
    assert fresh.conf.get(common.BATCH_BYTES) == common.DEFAULT_BYTES
    rows = fresh.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), F.lit(1 << 20)).alias("text"))
    assert max(r.n for r in batch_rows(rows).collect()) > 8
    assert max(r.n for r in common.materialise(batch_rows(rows), "test").collect()) <= 5
    assert fresh.conf.get(common.BATCH_BYTES) == common.DEFAULT_BYTES  # as it was
    common.bound_batches(fresh)
    assert max(r.n for r in batch_rows(rows).collect()) <= 5


def test_a_sessions_own_bound_stays(spark):
    own = spark.newSession()
    own.conf.set(common.BATCH_BYTES, "1m")
    common.bound_batches(own)
    with common.few_bytes(own):
        assert own.conf.get(common.BATCH_BYTES) in ("1m", "1048576b")


def test_materialised_tables_can_be_removed(spark):
    df = common.materialise(spark.range(10), "test")
    assert df.count() == 10
    common.discard(df)
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(df.inputFiles()[0].rpartition("/")[0]).count()
