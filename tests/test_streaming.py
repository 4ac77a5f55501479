import random

import pytest
from pyspark.sql import functions as F

from verbaflow.sources.texts import stream_texts
from verbaflow.streaming import texts as streaming

SCHEMA = "key long, at int, pieces int, piece string, time timestamp"
T0 = 1_700_000_000


def rows_of(texts, seed, start=T0):
    """The pieces of texts in mixed order, some twice."""
    r = random.Random(seed)
    out = []
    for key, text in texts.items():
        cut = [text[i : i + 3] for i in range(0, len(text), 3)]
        out += [(key, at, len(cut), p, start + r.randint(0, 20)) for at, p in enumerate(cut) for _ in range(r.choice((1, 1, 2)))]
    r.shuffle(out)
    return out


def put(spark, rows, path, files):
    """Files of pieces, each of which is a batch of its own."""
    for i in range(files):
        some = spark.createDataFrame(rows[i::files], SCHEMA.replace("timestamp", "long")).withColumn("time", F.col("time").cast("timestamp"))
        some.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture()
def stream(spark, tmp_path):
    def start():
        source = stream_texts(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, files_at_once=1)
        streaming.write_available(streaming.reassembled(source, "30 seconds", 60), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return spark.read.schema(streaming.REASSEMBLED).parquet(f"{tmp_path}/out").collect()

    return f"{tmp_path}/in", start


def test_texts_are_joined_over_batches_and_a_restart(spark, stream):
    path, start = stream
    texts = {k: "".join(random.Random(k).choice("abcdé ") for _ in range(k * 4 + 1)) for k in range(20)}
    rows = rows_of(texts, 1)
    half = len(rows) // 2
    put(spark, rows[:half], path, 2)
    first = start()
    assert len(first) < len(texts)
    put(spark, rows[half:], path, 2)  # from the checkpoint on
    found = start()
    assert {r.key: (r.text, r.whole) for r in found} == {k: (t, True) for k, t in texts.items()}
    assert len(found) == len(texts)  # none twice


def test_late_pieces_time_out(spark, stream):
    path, start = stream
    put(spark, [(1, 2, 3, "c", T0), (1, 0, 3, "a", T0), (2, 0, 2, "x", T0 + 1), (2, 1, 2, "y", T0 + 1)], path, 1)
    assert [(r.key, r.text, r.whole) for r in start()] == [(2, "xy", True)]
    put(spark, [(3, 0, 1, "later", T0 + 500)], path, 1)  # event time goes on
    put(spark, [(4, 0, 1, "more", T0 + 501)], path, 1)
    found = {(r.key, r.text, r.n_pieces, r.whole) for r in start()}
    assert found == {(2, "xy", 2, True), (1, "ac", 2, False), (3, "later", 1, True), (4, "more", 1, True)}


def test_texts_share_state(spark, tmp_path):
    """Calls and state are by share, so that they don't grow in number with the texts; texts of a share stay apart."""
    texts = {2**60 + k: "".join(random.Random(k).choice("abcdé ") for _ in range(k % 7 + 1)) for k in range(60)} | {None: "without a key"}
    rows = rows_of(texts, 2)
    put(spark, rows, f"{tmp_path}/in", 1)
    put(spark, [r for r in rows if r[0] is None or r[0] % 3], f"{tmp_path}/in", 1)  # again, to texts that are out
    put(spark, [(1, 0, 2, "x", T0 + 500), (2, 0, 1, "y", T0 + 501)], f"{tmp_path}/in", 1)
    put(spark, [(3, 0, 1, "z", T0 + 502)], f"{tmp_path}/in", 1)
    put(spark, [r[:4] + (T0 + 503,) for r in rows if r[0] == 2**60 + 6], f"{tmp_path}/in", 1)  # beyond its timer: begins anew
    source = stream_texts(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, files_at_once=1)
    query = streaming.write_available(streaming.reassembled(source, "30 seconds", 60, shares=3), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) == 4  # the three, and one without a key
    found = sorted((tuple(r) for r in spark.read.schema(streaming.REASSEMBLED).parquet(f"{tmp_path}/out").collect()), key=repr)
    pieces = lambda t: -(-len(t) // 3)
    known = [(k, t, pieces(t), True) for k, t in texts.items()] + [(2, "y", 1, True), (3, "z", 1, True)]
    known += [(2**60 + 6, texts[2**60 + 6], pieces(texts[2**60 + 6]), True)]
    assert found == sorted(known, key=repr)
