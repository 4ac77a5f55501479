"""Text operators on streams. All column operators of this library are stateless and work on a stream as they are. What needs
state is counting, by event-time window with a watermark, and joining the pieces of a text again, by keyed state with timers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import feather
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.tokenize import tokenize


def windowed_counts(stream: DataFrame, time: Column, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of lower-case tokens by window of `time`; what comes more than `late` behind is dropped."""
    rows = stream.select(time.alias("at"), F.explode(tokenize(F.col("text"))).alias("token")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window).alias("w"), F.lower("token").alias("word")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "word", "n")


REASSEMBLED = "key long, text string, n_pieces int, whole boolean"
#: Texts that are not out yet are kept in this many shares, by a hash of their keys; it stays for the life of a checkpoint.
SHARES = 1024
#: What has come for the texts of a share, as a compressed Arrow file of HELD.
STATE = "held binary"
#: A row for each piece: its place, how many the text has in all, and when (ms of event time) the text stops waiting. A text that is out
#: is one row with -1 for both numbers, by which pieces that come again are known.
HELD = ["key", "at", "pieces", "piece", "until"]


def reassembled(pieces: DataFrame, late: str = "10 minutes", wait: int = 600, shares: int = SHARES) -> DataFrame:
    """A stream pieces(key, at, pieces, piece, time), in any order, to key, text, n_pieces, whole: the pieces of a text numbered
    0 to pieces - 1, joined again.

    What comes more than `late` behind is dropped. A text goes out when its last piece comes. One whose pieces don't all come goes out as far as it is, in order, not
    whole, when event time is `wait` seconds beyond its latest piece; what comes for it later begins anew. Pieces that come
    twice count once. State and calls of Python are by share, not by text: a worker holds the waiting texts of one share at once.
    """
    share = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int"))
    rows = pieces.withWatermark("time", late).select(share.alias("share"), "key", "at", "pieces", "piece", "time", F.unix_millis("time").alias("ms"))
    return rows.groupBy("share").applyInPandasWithState(_joiner(wait), REASSEMBLED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _joiner(wait: int):
    def join(share: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = [feather.read_feather(pa.BufferReader(state.get[0]))] if state.exists else []
        before = sum(map(len, known))
        if not state.hasTimedOut:
            known += (some.assign(key=some["key"].astype("Int64"), until=np.maximum(some["ms"] + wait * 1000, now + 1))[HELD] for some in parts)
        rows = pd.concat(known, ignore_index=True)
        # what is known of each text, as arrays by its number
        text, keys = pd.factorize(rows["key"], use_na_sentinel=False)
        until, total, out, fresh = np.zeros(len(keys), "int64"), np.zeros(len(keys), "int64"), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        np.maximum.at(until, text, rows["until"].to_numpy())
        total[text] = rows["pieces"]
        out[text[rows["pieces"] < 0]] = True
        fresh[text[before:]] = True
        rows = rows.assign(text=text, until=until[text])
        rows = rows[~rows.duplicated(["text", "at"]) & (~out[text] | (rows["pieces"] < 0))]
        whole = ~out & (np.bincount(rows["text"], minlength=len(keys)) == total)
        due = ~fresh & (until < now)
        told = rows[(whole | due & ~out)[rows["text"]]].sort_values(["text", "at"])
        if len(told):
            piece, first = told["piece"].tolist(), np.flatnonzero(~told["text"].duplicated())
            ends = np.append(first[1:], len(told))
            joined = ["".join(piece[a:b]) for a, b in zip(first, ends, strict=True)]
            yield pd.DataFrame({"key": told["key"].array[first], "text": joined, "n_pieces": ends - first, "whole": whole[told["text"].array[first]]})
        left = rows[~(whole | due)[rows["text"]]]
        said = pd.DataFrame({"key": keys[whole], "at": -1, "pieces": -1, "piece": "", "until": until[whole]})
        left = pd.concat([left[HELD], said.astype(left[HELD].dtypes)], ignore_index=True)
        if len(left):
            packed = pa.BufferOutputStream()
            feather.write_feather(left, packed, compression="zstd")
            state.update((packed.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(int(left["until"].min()), now + 1))
        elif state.exists:
            state.remove()

    return join


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that the source has by now as Parquet, exactly once for a checkpoint, and ends."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one if all of Spark is in this process."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder; set it to one that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/verbaflow/{label}-{uuid.uuid4().hex}"


def written(stream: DataFrame, label: str) -> DataFrame:
    """What the source has by now, through write_available into a new shared folder, as a table."""
    path = shared_folder(stream.sparkSession, label)
    write_available(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
