"""Removal of long repeated strings by distributed prefix doubling over sampled positions.

Every byte that a string of LEAST bytes covers which also starts elsewhere goes. A row for each byte's suffix would be
many times the corpus, so strings stand together: of each LEAST-byte string the anchor is its half of least hash (the
first of equal ones), which depends on nothing but the string. Starts that follow each other mostly share their anchor; a
row is an anchor's position with its run of starts, by their distances to the anchor. Equal strings have equal anchors at
equal distances.

A row's rank is the name of the bytes that all its strings hold; at first those are the anchor's LEAST / 2. Spark sorts and
counts (position, rank) by rank, and rows whose rank is unique end. Of the others, those whose run as a whole occurs
elsewhere are past the threshold: all their starts are repeated, and one row of each such run goes on for the others to
meet. The rest are ranked anew at a greater length: the run is cut into FANOUT parts, and the rank of each is the pair of
the old rank and the bytes by which the part's strings agree beyond it. So what is known of a string grows from 100
bytes to 175, 194, 199 and 200 while runs shrink to one start. A row carries only bytes that no rank holds yet, fewer in
each round. Names are 128-bit digests, as a rank's number would be.

Before the rounds, positions whose anchor occurs once in the corpus are found by counting 64-bit hashes, and a filter of
bounded size keeps them off the shuffles; it may let some pass, which then end by their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT_ONCE, by_bytes, discard, materialise, shared_dir, table, tidy, unused

LEAST = 200
#: Parts that a run is cut into from one rank to the next.
FANOUT = 4
#: Bytes of texts whose anchors are found at once.
PIECE = 1 << 20
#: log2 of the most bits in the filter of repeated anchors, which has 16 bits for each, and 2^16 at least.
FILTER_BITS = 28
#: Keys whose results are broadcast, at most; beyond, a join shuffles.
FEW_KEYS = 100_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RANKED = "rank binary, own binary, first int, last int, low int, high int, before binary, after binary, key binary, at long"
PLACES = f"{RANKED}, stop long, many boolean"


def name(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _pairs(h: np.ndarray, rest: np.ndarray, step: int) -> np.ndarray:
    """The names of pairs: h at a position with rest `step` further on."""
    out = h[: len(rest) - step] * _A
    out += rest[step:]
    out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return out


def hashes(b: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the strings of `length` bytes at every position, by doubling: a name is that of two shorter ones."""
    some = b.astype(np.uint64) + np.uint64(1)
    some *= _B
    out, done, step = None, 0, 1
    while True:
        if length & step:
            out = some if out is None else _pairs(out, some, done)
            done += step
        if 2 * step > length:
            return out
        some = _pairs(some, some, step)
        step *= 2


def first_least(h: np.ndarray, width: int) -> np.ndarray:
    """Of each window of `width` positions the first one whose name is least."""
    low, at, n = h, np.arange(len(h), dtype=np.int32), 1
    while n < width:
        step = min(n, width - n)
        right = low[step:]
        left = low[: len(right)]
        at = np.where(right < left, at[step:], at[: len(right)])
        low = np.minimum(left, right)
        n += step
    return at


class Runs:
    """The runs of starts of one buffer of texts, each with its anchor."""

    def __init__(self, texts: list[bytes], least: int = LEAST):
        half = least // 2
        self.buffer = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        n = len(self.buffer) - least + 1
        self.text = self.anchor = self.start = self.stop = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if n <= 0:
            return
        h = hashes(np.frombuffer(self.buffer, np.uint8), half)
        at = first_least(h, least - half + 1)
        for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            at[max(begin, end - least + 1) : end] = -1  # strings that a text does not hold
        cut = np.flatnonzero(np.diff(at)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
        held = at[begin] >= 0
        self.start, self.stop = begin[held], end[held]
        self.anchor = at[self.start].astype(np.int64)
        self.hash = h[self.anchor]
        self.text = np.searchsorted(ends, self.start, "right")
        self.base = np.concatenate([[0], ends[:-1]])


def _pieces(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[bytes], list[bytes], list[int]]]:
    """Texts with their keys and where they begin in the whole text: some short ones together, a long one in pieces that
    share what strings at their border need. Texts that are too short for a string are left out."""
    for batch in batches:
        for some in by_bytes(batch, 0, PIECE):
            texts = [t for t in some.column(0).to_pylist() if t is not None and len(t) >= least]
            if len(texts) == 1 and len(texts[0]) > PIECE:
                key = hashlib.md5(texts[0]).digest()
                for low in range(0, len(texts[0]) - least + 1, PIECE):
                    yield [texts[0][low : low + PIECE + least - 1]], [key], [low]
            elif texts:
                yield texts, [hashlib.md5(t).digest() for t in texts], [0] * len(texts)


def _repeats_itself(runs: Runs) -> np.ndarray:
    """Runs that follow on an equal one of the same text: the text repeats itself at once, as a line of dashes does."""
    a = runs.anchor
    same = np.zeros(len(a), bool)
    if len(a) > 1:
        same[1:] = (runs.hash[1:] == runs.hash[:-1]) & (runs.text[1:] == runs.text[:-1]) & (runs.start[1:] == runs.stop[:-1])
        same[1:] &= (a[1:] - runs.start[1:] == a[:-1] - runs.start[:-1]) & (np.diff(runs.start) == np.diff(runs.stop))
    return same


def _mixed(key: bytes, at: np.ndarray) -> np.ndarray:
    out = (np.frombuffer(key[:8], np.uint64)[0] + at.astype(np.uint64)) * _A
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def _counter(least: int):
    """The hashes of all anchors, each with a number that tells its place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, keys, base in _pieces(batches, least):
            runs = Runs(texts, least)
            if not len(runs.hash):
                continue
            inside = runs.anchor - runs.base[runs.text] + np.array(base)[runs.text]
            cuts = np.searchsorted(runs.text, np.arange(len(texts) + 1))
            place = np.concatenate([_mixed(keys[i], inside[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
            again = _repeats_itself(runs)
            keep = ~(again & np.append(again[1:], False))  # the first and the last of equal neighbours tell enough
            yield pa.RecordBatch.from_arrays([pa.array(runs.hash[keep].view(np.int64)), pa.array(place[keep])], names=["hash", "place"])

    return tidy(count)


def _spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return (h * _A >> shift).astype(np.int64), (h * _B >> shift).astype(np.int64)


def _filter_of(repeated: DataFrame) -> tuple[bytes, int]:
    """Two bits for each of the hashes, in a field whose size is bounded, so that it may be collected page by page."""
    bits = max(16, min(FILTER_BITS, math.ceil(math.log2(16 * max(1, repeated.count())))))

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.unique(np.concatenate(_spots(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(both >> 16), pa.array((both & 0xFFFF).astype(np.int32))], names=["page", "bit"])

    def mark(part: pa.Table) -> pa.Table:
        on = np.zeros(1 << 16, np.uint8)
        on[part["bit"].to_numpy()] = 1
        return pa.table({"page": pa.array([part["page"][0].as_py()], pa.int64()), "data": pa.array([np.packbits(on).tobytes()], pa.binary())})

    marked = repeated.select("hash").mapInArrow(spot, "page long, bit int").distinct()
    out = bytearray(1 << (bits - 3))
    for row in marked.groupBy("page").applyInArrow(mark, "page long, data binary").toLocalIterator():
        out[row.page << 13 : (row.page + 1) << 13] = row.data
    return bytes(out), bits


def _placer(sent, bits: int, least: int):
    """Rows of PLACES for the anchors that pass the filter."""
    half = least // 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(sent.value, np.uint8)
        found: list[tuple] = []
        for texts, keys, base in _pieces(batches, least):
            runs = Runs(texts, least)
            held = np.ones(len(runs.hash), bool)
            for spot in _spots(runs.hash, bits):
                held &= (on[spot >> 3] >> (7 - (spot & 7)) & 1).astype(bool)
            again, b = _repeats_itself(runs), runs.buffer
            for r in np.flatnonzero(held).tolist():
                start, stop, at, text = int(runs.start[r]), int(runs.stop[r]), int(runs.anchor[r]), int(runs.text[r])
                whole = b[start : stop + least - 1]
                if again[r] and found and b[start - (at - found[-1][-1]) : stop + least - 1 - (at - found[-1][-1])] == whole:
                    found[-1] = (*found[-1][:10], stop - 1 + least - int(runs.base[text]) + base[text], True, at)
                    continue
                shift = base[text] - int(runs.base[text])
                rank, low, high = name(b[at : at + half]), at - stop + 1, at - start
                found.append((rank, name(rank, low.to_bytes(4), high.to_bytes(4), whole), 0, least - half, low, high, b[start:at], b[at + half : stop - 1 + least], keys[text], at + shift, stop - 1 + least + shift, False, at))
            if found:
                yield _rows([f[:-1] for f in found], PLACES)
                found = []

    return tidy(place)


_KINDS = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[kind]) for v, (_, kind) in zip(zip(*rows, strict=True), columns, strict=True)], names=[c for c, _ in columns])


def parts_of(first: int, last: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """The parts that a run of distances is cut into, the same for all rows."""
    n = last - first + 1
    cuts = [first + n * i // min(fanout, n) for i in range(min(fanout, n) + 1)]
    return [(a, b - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _reranker(least: int):
    """A row of distances first to last, of which it has low to high: all its strings hold the bytes from `first` before the
    anchor to `least - last` after it; before and after are what its own strings have beyond. To rows of the parts."""

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rank, first, last, low, high, before, after, key, at in zip(*(batch.column(c).to_pylist() for c in ("rank", "first", "last", "low", "high", "before", "after", "key", "at")), strict=True):
                for a, b in parts_of(first, last):
                    lower, upper = max(a, low), min(b, high)
                    if lower > upper:
                        continue
                    known = name(rank, bytes([a & 255, a >> 8, b & 255, b >> 8]), before[len(before) - (a - first) :] if a > first else b"", after[: last - b])
                    mine, theirs = before[high - upper : high - a], after[last - b : last - lower]
                    out.append((known, name(known, lower.to_bytes(4), upper.to_bytes(4), mine, theirs), a, b, lower, upper, mine, theirs, key, at))
            if out:
                yield _rows(out, RANKED)

    return tidy(rerank)


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs(text binary) to key, start, stop: bytes of the text with that MD5 which repeated strings cover, as runs that may
    overlap and repeat. Equal texts are one text here."""
    spark = docs.sparkSession
    counted = docs.mapInArrow(_counter(least), "hash long, place long").groupBy("hash").agg(F.min("place").alias("p"), F.max("place").alias("q"))
    repeated = materialise(counted.where("p <> q").select("hash"), "repeats-hashes")
    marks, bits = _filter_of(repeated)
    discard(repeated)
    sent = spark.sparkContext.broadcast(marks)
    places = materialise(docs.mapInArrow(_placer(sent, bits, least), PLACES), "repeats-places")
    out = shared_dir(spark, "repeats-found")
    keep = lambda rows: rows.write.mode("append").parquet(out)
    # the first round: rows of equal texts are one place
    place = F.xxhash64("key", "at")
    fields = [c.split()[0] for c in RANKED.split(", ") if not c.startswith("own ")]
    one = F.first(F.struct(*fields)).alias("one")
    each = materialise(_settled(places.groupBy("own").agg((F.bool_or("many") | (F.min(place) != F.max(place))).alias("again"), one)), "repeats-runs")
    keep(places.join(each.where("key IS NULL").select("own"), "own", "left_semi").select("key", (F.col("at") - F.col("high")).alias("start"), "stop"))
    discard(places)
    rows = _met(each)
    discard(each)
    while (last := rows.agg(F.max(F.col("last") - F.col("first"))).first()[0]) is not None and last > 0:
        ranked = materialise(rows.mapInArrow(_reranker(least), RANKED), "repeats-ranked")
        discard(rows)
        each = ranked.groupBy("own").agg((F.count(F.lit(1)) > 1).alias("again"), one)
        again = each.where("again").select("own")
        keep(ranked.where("key IS NOT NULL").join(again, "own", "left_semi").select("key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + least).alias("stop")))
        left = materialise(_settled(each).where("last > first"), "repeats-left")
        discard(ranked)
        rows = _met(left)
        discard(left)
    discard(rows)
    sent.unpersist()
    return spark.read.schema("key binary, start long, stop long").parquet(out)


def _settled(each: DataFrame) -> DataFrame:
    """One row of each run; a run that is past the threshold is no text's any more."""
    rows = each.select("own", "again", "one.*")
    return rows.withColumns({"key": F.when(~F.col("again"), F.col("key")), "at": F.when(~F.col("again"), F.col("at"))}).drop("again")


def _met(rows: DataFrame) -> DataFrame:
    """The rows whose rank is not unique, where one of it is still open."""
    ranks = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("key").isNotNull()).alias("open")).where("n > 1 AND open").select("rank")
    return materialise(rows.drop("own").join(ranks, "rank", "left_semi"), "repeats-rows")


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that any of the spans covers."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _kept(text: bytes, starts: np.ndarray, stops: np.ndarray) -> Iterator[bytes]:
    low = 0
    for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
        yield text[low:start]
        low = stop
    yield text[low:]


def _by_key(docs: DataFrame, least: int) -> DataFrame:
    """key, whole, start, stop: of each text that loses bytes its spans; whole: it is one of several equal texts, all of which
    goes. Of these no spans are told."""
    key = F.unhex(F.md5("text"))
    copies = docs.where(F.octet_length("text") >= least).select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    copies = materialise(copies, "repeats-copies")
    found = repeated_runs(docs, least)
    spans = found.distinct().join(copies, "key", "left_anti").groupBy("key").agg(F.collect_list("start").alias("start"), F.collect_list("stop").alias("stop"))
    none = F.lit(None).cast("array<long>")
    whole = copies.select("key", F.lit(True).alias("whole"), none.alias("start"), none.alias("stop"))
    out = materialise(whole.unionByName(spans.withColumn("whole", F.lit(False))), "repeats-spans")
    discard(copies, found)
    return out


def _picked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The texts (key, text) with spans, and few others: a filter of bounded size stands before the shuffle."""
    as_hash = lambda key: F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").alias("hash")
    marks, bits = _filter_of(spans.where("NOT whole").select(as_hash("key")))
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for some in by_bytes(batch, 1, AT_ONCE):
                held = np.ones(some.num_rows, bool)
                keys = some.column(0).to_pylist()
                for spot in _spots(np.array([int.from_bytes(k[:8]) for k in keys], np.uint64), bits):
                    held &= (on[spot >> 3] >> (7 - (spot & 7)) & 1).astype(bool)
                yield some.filter(pa.array(held))

    return docs.where("text IS NOT NULL").select(F.unhex(F.md5("text")).alias("key"), "text").mapInArrow(tidy(pick), "key binary, text binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            key, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            starts, stops = merged(*(batch.column(c)[i].values.to_numpy() for c in (2, 3)))
            digest = hashlib.sha256()
            for part in _kept(text, starts, stops):
                digest.update(part)
            out.append((key, int((stops - starts).sum()), len(starts), digest.digest()))
        if out:
            yield _rows(out, "key binary, n_removed long, n_spans long, sha binary")


def removals(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs(text) with n_bytes, n_removed, n_spans and kept_sha256 in place of text and of columns of these names.

    Null texts are empty. A text that has a copy goes as a whole if it has `least` bytes or more, else nothing of it; so
    repeated rows are not looked at one by one. Texts are told by their MD5. A very long text is worked on in
    pieces that overlap. Other columns pass through. An empty table gives no rows.
    """
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    by_key = _by_key(texts, least)
    cut = _picked(texts, by_key).join(by_key.where("NOT whole").select("key", "start", "stop"), "key").mapInArrow(tidy(_cut), "key binary, n_removed long, n_spans long, sha binary")
    gone = by_key.where("whole").select("key", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").digest()).alias("sha"))
    results = materialise(cut.unionByName(gone), "repeats-results")
    discard(by_key)
    few = results.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    key, found, sha = (unused(docs, column) for column in ("__key", "__found", "__sha"))
    results = results.select(F.col("key").alias(key), F.struct("n_removed", "n_spans", "sha").alias(found))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    told = docs.select(F.unhex(F.md5(text)).alias(key), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias(sha), *rest)
    out = told.join(F.broadcast(results) if few else results, key, "left")
    removed = F.col(f"{found}.n_removed")
    return out.select(
        *rest, "n_bytes", F.coalesce(F.when(removed < 0, F.col("n_bytes")).otherwise(removed), F.lit(0)).alias("n_removed"),
        F.coalesce(f"{found}.n_spans", F.lit(0)).alias("n_spans"), F.coalesce(F.lower(F.hex(f"{found}.sha")), sha).alias("kept_sha256"),
    )


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty, as are empty ones: nothing is removed. Rows with equal or null ids are rows of their own. Other
    columns are ignored."""
    return removals(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h, encode(coalesce(text, '')) AS bytes FROM documents),
s AS (SELECT n, i, md5_number(array_slice(bytes, i + 1, i + {LEAST})) AS m FROM (SELECT n, bytes, unnest(range(octet_length(bytes) - {LEAST - 1})) AS i FROM d WHERE octet_length(bytes) >= {LEAST})),
r AS (SELECT n, i FROM s WHERE m IN (SELECT m FROM s GROUP BY m HAVING count(*) > 1)),
e AS (SELECT n, i, i > coalesce(lag(i) OVER (PARTITION BY n ORDER BY i) + {LEAST}, -1) AS fresh FROM r),
g AS (SELECT n, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY n ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
t AS (SELECT n, run, min(i) AS a, max(i) + {LEAST} AS b FROM g GROUP BY n, run),
k AS (
  SELECT n, sum(b - a) AS removed, count(*) AS spans, string_agg(part, '' ORDER BY a) AS h FROM (
    SELECT t.n, a, b, h[2 * coalesce(lag(b) OVER (PARTITION BY t.n ORDER BY a), 0) + 1 : 2 * a] || CASE WHEN lead(a) OVER (PARTITION BY t.n ORDER BY a) IS NULL THEN h[2 * b + 1 :] ELSE '' END AS part
    FROM t JOIN d ON d.n = t.n
  ) GROUP BY n
)
SELECT d.doc_id, CAST(len(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, coalesce(k.spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN k USING (n)
"""
