import json
import os
import re
import uuid
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from verbaflow.sources import freqlist


@pytest.fixture(scope="module")
def session(spark):
    freqlist.register(spark)
    return spark


def lines(n):
    return ["The distribution of a corpus", "Lexicon size: 7 types", "", " - tokens"] + [f"{i + 1} {n - i}.{i % 100:02d} wört{i}" for i in range(n)]


@pytest.mark.parametrize("split", [1, 7, 40, 10_000])
def test_ranges_of_bytes_hold_every_line_once(session, tmp_path, split):
    (tmp_path / "list.num").write_text("\n".join(lines(60)) + "\n", encoding="utf-8")
    rows = session.read.format("freqlist").option("path", str(tmp_path / "list.num")).option("split_bytes", split).load().collect()
    assert sorted(map(tuple, rows)) == [(i + 1, Decimal(f"{60 - i}.{i % 100:02d}"), f"wört{i}") for i in range(60)]


def test_filters_are_done_by_the_source(session, tmp_path):
    (tmp_path / "list.num").write_text("\n".join(lines(500)), encoding="utf-8")
    df = session.read.format("freqlist").option("path", str(tmp_path / "list.num")).option("in_order", "true").load()
    few = df.where((F.col("rank") <= 5) & (F.col("freq") > F.lit(Decimal("497.50"))))
    assert [r.word for r in few.orderBy("rank").collect()] == ["wört0", "wört1", "wört2"]
    said = few._sc._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [LessThanOrEqual(rank,5), GreaterThan(freq,497.50)]" in said and "(rank#" not in said.split("Condition")[1].replace("isnotnull(rank#", "")
    assert df.where("word = 'wört7'").count() == 1 and df.where("word LIKE '%9'").count() == 50


def test_early_end():
    source = freqlist.Reader({"path": "x", "in_order": "true"})
    rest = list(source.pushFilters([freqlist.LessThan(("rank",), 3), freqlist.EqualTo(("word",), None)]))
    assert [type(f) for f in rest] == [freqlist.EqualTo] and len(source.filters) == 1


def test_round_trip(session, tmp_path):
    path = str(tmp_path / "out")
    df = session.range(100).select((F.col("id") + 1).cast("int").alias("rank"), (1000 - F.col("id")).cast("decimal(12,2)").alias("freq"), F.concat(F.lit("w"), F.col("id")).alias("word"))
    df.repartition(4).write.format("freqlist").mode("append").option("path", path).save()
    back = session.read.format("freqlist").option("path", path).load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert json.load(open(f"{path}/_totals")) == {"n": 100, "total": "95050.00"}
    assert not [f for f in os.listdir(path) if f.startswith("_writing")]
    df.limit(1).write.format("freqlist").mode("overwrite").option("path", path).save()
    assert session.read.format("freqlist").option("path", path).load().count() == 1


def test_a_failed_write_leaves_nothing(session, tmp_path):
    path = str(tmp_path / f"bad-{uuid.uuid4().hex}")
    df = session.range(40).repartition(4).select(F.col("id").cast("int").alias("rank"), F.lit(1).cast("decimal(12,2)").alias("freq"), F.when(F.col("id") == 39, "two words").otherwise("word").alias("word"))
    with pytest.raises(Exception, match="no entry of a list"):
        df.write.format("freqlist").mode("append").option("path", path).save()
    assert not os.path.exists(path) or not [f for f in os.listdir(path) if f.startswith(("part", "_"))]
    with pytest.raises(Exception, match="columns"):
        session.range(1).write.format("freqlist").mode("append").option("path", path).save()


def test_lists_are_written_in_batches():
    assert issubclass(freqlist.Writer, freqlist.DataSourceArrowWriter)
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert pc.match_substring_regex(pa.array(signs), freqlist.BLANK).to_pylist() == [bool(re.search(r"\s", c)) for c in signs]
