"""N-gram Jaccard join by rare-first prefix filtering.

A document is its set of distinct word shingles, as 64-bit hashes; equal sets are one class. All shingles have one
order: by document frequency, rare first, then by hash. The frequency is that of a count-min sketch of fixed size over
all distinct shingles of all sets. Any order gives all links; this one keeps common passages out of the prefixes.
Two sets of similarity THRESHOLD or more share a shingle in their prefixes, the first n - ceil(t n) + 1 of n. The
prefixes' postings meet by shingle and pass the length and positional filters: at the first shingle that two sets share,
what follows it must be long enough. A suffix filter on marks (each shingle flips one of a set's bits; sets that differ
in d shingles differ in d bits at most) leaves few pairs, and each of those is verified once on the whole sets.

Large groups of near copies would make candidate pairs by the square. So postings of a shingle are first paired with a
leader of similar size and a neighbour only, and of the pairs that marks let pass each set's likeliest is verified
first. Then a list is looked at again only where its members are still in several components: block against block inside
a task, with a row for each pair only where these are few for the list's rows. In dense lists each member outside the main
component finds its likeliest partner in another one by marks, and at last all partners whom marks let pass. That leaves
out pairs inside one component, whose links change nothing.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, discard, materialise, table, tidy, unused

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
#: log2 of the sketch's counters; a block of them is one row.
SKETCH_BITS, BLOCK_BITS = 22, 16
#: Postings of one shingle that meet in one task; beyond, they are dealt over several.
HOT = 4096
#: Members of a list on either side that meet in one task when it is looked at again.
SIDE = 2048
#: Pairs for each of a list's rows up to which they are told as pairs; a list with more keeps rows until marks have refused most.
SPARSE = 4
#: Postings of one partition, about.
POSTINGS = 1_500_000
#: Ids that are broadcast, at most, to pick their rows; beyond, a join shuffles or a filter of bounded size picks.
FEW_IDS = 100_000
#: Links of which one task makes a forest.
LINKS = 100_000
#: log2 of the most bits in the filter of wanted sets, which has 16 bits for each, and 2^16 at least.
FILTER_BITS = 29
#: Marks have four to eight bits for each shingle, and these at least.
LEAST_MARKS = 64
#: Distinct shingles that a task counts at once.
COUNTED = 2_000_000
#: Tasks' shares of a block of the sketch that are added at once.
SHARES_AT_ONCE = 32
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 19
SURVEY = ["block", "doc_id", "id", "n", "data", "key", "marks"]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2B
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sets of shingle hashes. A word's hash is a polynomial in _BASE over its bytes' values, taken from running sums over
    the whole piece of text; A to Z have the values of a to z."""

    def __init__(self, k: int):
        self.k = k
        self.value = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
        self.value[65:91] = self.value[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[[32, 9, 10, 11, 12, 13]] = True
        self._reach(PIECE + 1)

    def _reach(self, n: int) -> None:
        """Powers of the base, and of its inverse, up to n."""
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of a text's words, and where they begin."""
        b = np.frombuffer(text, np.uint8)
        if len(b) > len(self.power):  # one word longer than a piece
            self._reach(len(b))
        gap = np.concatenate([[True], self.gap[b], [True]])
        start = np.flatnonzero(gap[:-1] & ~gap[1:])
        end = np.flatnonzero(~gap[:-1] & gap[1:])
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.value[b] * self.power[: len(b)], out=sums[1:])
        return _mixed((sums[end] - sums[start]) * self.inverse[start]), start

    def _joined(self, words: np.ndarray, size: int) -> np.ndarray:
        """The hash of every run of `size` words."""
        out = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            out = out * _ODD + words[i : len(words) - size + 1 + i]
            out ^= out >> np.uint64(29)
        return _mixed(out)

    def _sets(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        runs = self._joined(words, self.k) if len(words) >= self.k else words[:0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s = runs[a : b - self.k + 1].copy() if b - a >= self.k else self._joined(words[a:b], b - a) if b > a else words[:0]
            s.sort()
            new = s[1:] != s[:-1]
            yield s if new.all() else s[np.concatenate([[True], new])]

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Of each text the sorted distinct shingle hashes; of fewer than k words, one of the whole sequence; of none, nothing."""
        some: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            if some and size + len(text) >= PIECE:
                yield from self._together(some)
                some, size = [], 0
            if len(text) > PIECE:
                words = np.concatenate([self.words(p)[0] for p in pieces(text)])
                yield from self._sets(words, np.array([0, len(words)]))
            else:
                some.append(text)
                size += len(text) + 1
        if some:
            yield from self._together(some)

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        words, start = self.words(b"\n".join(texts))
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return self._sets(words, np.searchsorted(start, at))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text cut where no word is cut, every PIECE bytes or after."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def least_overlap(n: int, t: tuple[int, int] = (NUMERATOR, DENOMINATOR)) -> int:
    return -(-t[0] * n // t[1])


def linked(a: np.ndarray, b: np.ndarray, t: tuple[int, int] = (NUMERATOR, DENOMINATOR)) -> bool:
    """Whether t[1] * |a and b| >= t[0] * |a or b|, with the suffix filter first: no overlap is larger than what both
    halves around a pivot allow."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) * t[1] < max(n, m) * t[0]:
        return False
    need = -(-t[0] * (n + m) // (t[0] + t[1]))
    i = n // 2
    j = int(np.searchsorted(b, a[i]))
    if min(i, j) + min(n - i, m - j) < need:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def marks_of(s: np.ndarray) -> bytes:
    """A power of two of bits, four to eight for each shingle; a shingle flips the one that its hash's lowest bits name.
    The halves of marks, one flipped by the other, are the marks of half as many bits."""
    n = max(LEAST_MARKS, 4 << (len(s) - 1).bit_length())
    flips = np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def distance(p: bytes, q: bytes) -> int:
    """In how many bits marks differ, those of more bits folded down to the other's number."""
    if len(p) < len(q):
        p, q = q, p
    x = int.from_bytes(p, "little")
    size = len(p)
    while size > len(q):
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ int.from_bytes(q, "little")).bit_count()


def _identity(s: np.ndarray, clashing: frozenset[int]) -> tuple[int, bytes]:
    """A set's id and its digest. Ids are the digest's first half, or the second where different sets clash in the first."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    first = int.from_bytes(digest[:8], "little", signed=True)
    return (int.from_bytes(digest[8:], "little", signed=True) if first in clashing else first), digest


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _surveyor(k: int):
    """(doc_id, text) to a row for each document (block -1; marks only where this task meets a set first) and this task's
    share of the sketch, one row a block that it has counted in, compressed: what a task writes follows what it reads.

    The sketch counts, in the cell of each shingle, the sets that hold it; sets that several tasks meet count once for each.
    """

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingler, seen, counts = Shingler(k), set(), np.zeros(1 << SKETCH_BITS, np.uint32)
        waiting: list[np.ndarray] = []

        def count() -> None:
            counts[:] += np.bincount(_cells(np.concatenate(waiting)), minlength=len(counts)).astype(np.uint32)
            waiting.clear()

        n_waiting = 0
        for batch in batches:
            for some in by_bytes(batch, 1):
                sizes, ids, digests, keys, marks = [], [], [], [], []
                texts = some.column(1).to_pylist()
                for raw, s in zip(texts, shingler.sets(texts), strict=True):
                    i, digest = _identity(s, frozenset()) if len(s) else (None, None)
                    sizes.append(len(s))
                    ids.append(i)
                    digests.append(digest)
                    keys.append(hashlib.md5(raw).hexdigest() if len(s) else None)
                    new = len(s) > 0 and i not in seen
                    marks.append(marks_of(s) if new else None)
                    if new:
                        seen.add(i)
                        waiting.append(s)
                        n_waiting += len(s)
                        if n_waiting >= COUNTED:
                            count()
                            n_waiting = 0
                cols = [pa.array([-1] * some.num_rows, pa.int32()), some.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.string()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=SURVEY)
        if waiting:
            count()
        size, pack = 1 << BLOCK_BITS, zstandard.ZstdCompressor(level=1)
        for b in range(len(counts) // size):
            part = counts[b * size : (b + 1) * size]
            if part.any():
                cols = [pa.array([b], pa.int32()), *(pa.array([None], pa.int64()) for _ in range(3)), pa.array([pack.compress(part.tobytes())], pa.binary()), pa.array([None], pa.string()), pa.array([None], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=SURVEY)

    return tidy(survey)


def _added(parts: pa.Table) -> pa.Table:
    import zstandard

    total, unpack = np.zeros(1 << BLOCK_BITS, np.uint64), zstandard.ZstdDecompressor()
    for part in parts["data"]:
        total += np.frombuffer(unpack.decompress(part.as_py()), np.uint32)
    data = zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes())
    return pa.table({"block": pa.array([parts["block"][0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})


def _whole_sketch(shares: DataFrame) -> bytes:
    """The sum of the tasks' shares, added in rounds of some SHARES_AT_ONCE a block, so that no task sees them all."""
    import zstandard

    blocks = 1 << (SKETCH_BITS - BLOCK_BITS)
    each, made = -(-shares.count() // blocks), []
    while each > 2 * SHARES_AT_ONCE:
        each = -(-each // SHARES_AT_ONCE)
        part = F.pmod(F.monotonically_increasing_id(), F.lit(each)).alias("part")
        shares = materialise(shares.select("block", "data", part).groupBy("block", "part").applyInArrow(_added, "block int, data binary"), "jaccard-sketch")
        made.append(shares)
    sketch, unpack = bytearray(4 << SKETCH_BITS), zstandard.ZstdDecompressor()
    for row in shares.groupBy("block").applyInArrow(_added, "block int, data binary").toLocalIterator():
        sketch[row.block << (BLOCK_BITS + 2) : (row.block + 1) << (BLOCK_BITS + 2)] = unpack.decompress(bytes(row.data))
    discard(*made)
    return bytes(sketch)


def _poster(sketch, clashing: frozenset[int], k: int, t: tuple[int, int]):
    """(doc_id, text) to the prefix postings (shingle, salt, id, size, pos) of each set that this task meets first.

    A cell's count less the mean one is the shingle's frequency, about. Where that is above HOT the salt, from 0, deals the
    shingle's postings over tasks; elsewhere it is -1.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, np.uint32)
        mean = int(counts.mean())
        shingler, seen = Shingler(k), set()
        for batch in batches:
            for some in by_bytes(batch, 1):
                found: list[tuple] = []
                for s in shingler.sets(some.column(1).to_pylist()):
                    if not len(s):
                        continue
                    i, _ = _identity(s, clashing)
                    if i in seen:
                        continue
                    seen.add(i)
                    often = counts[_cells(s)]
                    p = len(s) - least_overlap(len(s), t) + 1
                    first = np.argsort(often, kind="stable")[:p]  # s is sorted by hash already
                    found.append((s[first], often[first].astype(np.int64) - mean, i, len(s)))
                if found:
                    yield _postings(found)

    return tidy(post)


def _postings(found: list[tuple]) -> pa.RecordBatch:
    lengths = [len(f[0]) for f in found]
    sh, often = (np.concatenate([f[c] for f in found]) for c in (0, 1))
    ids = np.repeat(np.array([f[2] for f in found], np.int64), lengths)
    salt = np.where(often > HOT, ids % np.maximum(1, -(-often // HOT)), -1).astype(np.int32)
    cols = [sh.view(np.int64), salt, ids, np.repeat(np.array([f[3] for f in found], np.int32), lengths), np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sh", "salt", "id", "size", "pos"])


def least_common(n, m, t: tuple[int, int]):
    """What sets of n and m shingles must have in common to link."""
    return -(-t[0] * (n + m) // (t[0] + t[1]))


def near_enough(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """The length and positional filters for sets of n and m that share the shingle at prefix positions i and j (from 0).

    They hold for two sets that link at the first shingle that they share, which both prefixes hold: nothing before it is
    common, and what follows it is as long as the shorter rest at most.
    """
    return (np.minimum(n, m) * t[1] >= np.maximum(n, m) * t[0]) & (1 + np.minimum(n - i - 1, m - j - 1) >= least_common(n, m, t))


def _leader_pairs(t: tuple[int, int]):
    """One partition's postings, whole lists each, to: pairs with a leader or neighbour (kind 0), postings to look at again
    (kind 1), and the leaders of lists that were dealt over several tasks (kind 2)."""
    width = math.log(t[1] / t[0])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        sh, salt, ids, size, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((salt, sh))
        edge = np.flatnonzero((np.diff(sh[order]) != 0) | (np.diff(salt[order]) != 0)) + 1
        length = np.diff(np.concatenate([[0], edge, [len(order)]]))
        keep = order[np.repeat(length > 1, length) | (salt[order] >= 0)]
        sh, salt, ids, size, pos = (c[keep] for c in (sh, salt, ids, size, pos))
        if not len(sh):
            return
        # a set's id is a hash, so that the first of a band is any of its members, and the same in most lists
        order = np.lexsort((ids, np.floor(np.log(size) / width + 1e-9), salt, sh))
        sh, salt, ids, size, pos = (c[order] for c in (sh, salt, ids, size, pos))
        # copies of a set that several tasks posted
        fresh = np.concatenate([[True], (np.diff(sh) != 0) | (np.diff(salt) != 0) | (np.diff(ids) != 0)])
        sh, salt, ids, size, pos = (c[fresh] for c in (sh, salt, ids, size, pos))
        often = salt >= 0
        band = np.floor(np.log(size) / width + 1e-9).astype(np.int64)
        group = np.concatenate([[True], (np.diff(sh) != 0) | (np.diff(salt) != 0)])
        starts = group | np.concatenate([[True], np.diff(band) != 0])
        leader = np.maximum.accumulate(np.where(starts, np.arange(len(sh)), 0))
        me = np.arange(len(sh))
        one = np.concatenate([leader[~starts], me[~group] - 1])
        two = np.concatenate([me[~starts], me[~group]])
        ok = near_enough(size[one].astype(np.int64), pos[one].astype(np.int64), size[two].astype(np.int64), pos[two].astype(np.int64), t)
        a, b = np.minimum(ids[one[ok]], ids[two[ok]]), np.maximum(ids[one[ok]], ids[two[ok]])
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield _rows(0, np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1], None, None)
        count = np.diff(np.concatenate([np.flatnonzero(group), [len(sh)]]))
        again = np.repeat(count > 2, count) | often
        yield _rows(1, sh[again], ids[again], None, size[again], pos[again])
        heads = starts & often
        yield _rows(2, sh[heads], ids[heads], band[heads], size[heads], pos[heads])

    return tidy(lead)


def _rows(kind: int, sh, a, b, size, pos) -> pa.RecordBatch:
    n = len(a)
    blank = np.zeros(n, np.int64)
    cols = [np.full(n, kind, np.int32), sh, a, blank if b is None else b, *((blank if c is None else c).astype(np.int32) for c in (size, pos))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "sh", "a", "b", "size", "pos"])


def _release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(rows: DataFrame) -> DataFrame:
    """rows of a few numbers each, to be broadcast if they are FEW_IDS or fewer."""
    return F.broadcast(rows) if rows.limit(FEW_IDS + 1).count() <= FEW_IDS else rows


def of_ids(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose ids are among some n ids, which may repeat."""
    return rows.join(F.broadcast(ids) if n <= FEW_IDS else ids.distinct(), "id", "left_semi")


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def _likely(t: tuple[int, int]):
    """Pairs (a, b, n, m, p, q), with sizes and marks, to the ones that marks don't refuse: a, b, score."""

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, p, q = (batch.column(c).to_pylist() for c in ("a", "b", "n", "m", "p", "q"))
            out: tuple[list, list, list] = ([], [], [])
            for k in range(batch.num_rows):
                both = n[k] + m[k]
                apart = distance(p[k], q[k])
                if apart <= both - 2 * least_common(n[k], m[k], t):
                    for column, x in zip(out, (a[k], b[k], 1 - apart / both), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "score"])

    return tidy(pass_on)


def likely(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Of distinct pairs (a, b) the ones whose marks may be of linked sets, with a score; sets(id, n, marks)."""
    some = materialise(of_ids(sets.select("id", "n", "marks"), ids_of(pairs), 2 * pairs.count()), "jaccard-marks")
    half = pairs.join(some.select(F.col("id").alias("a"), "n", F.col("marks").alias("p")), "a")
    both = half.join(some.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("marks").alias("q")), "b").select("a", "b", "n", "m", "p", "q")
    found = materialise(both.mapInArrow(_likely(t), "a long, b long, score double"), "jaccard-likely")
    discard(some)
    return found


def best_of_each(scored: DataFrame) -> DataFrame:
    """Of pairs (a, b, score) the likeliest of every id, once each."""
    ends = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    best = ends.groupBy("a").agg(F.max(F.struct("score", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()


def _spot(key, bits: int):
    """The range of a hexadecimal key: its first `bits` bits."""
    return F.shiftright(F.conv(F.left(key, F.lit(8)), 16, 10).cast("long"), 32 - bits).cast("int")


def _filter_of(keys: DataFrame) -> tuple[bytes, int]:
    """A bit for each of 2^bits ranges of keys that holds one of keys; its size is bounded, so it may be collected."""
    bits = max(16, min(FILTER_BITS, math.ceil(math.log2(16 * max(1, keys.count())))))

    def mark(part: pa.Table) -> pa.Table:
        on = np.zeros(1 << 16, np.uint8)
        on[part["bit"].to_numpy()] = 1
        return pa.table({"page": pa.array([part["page"][0].as_py()], pa.int32()), "data": pa.array([np.packbits(on).tobytes()], pa.binary())})

    spot = _spot(F.col("key"), bits)
    marked = keys.select(F.shiftright(spot, 16).alias("page"), spot.bitwiseAND(F.lit(0xFFFF)).alias("bit")).distinct()
    out = bytearray(1 << (bits - 3))
    for row in marked.groupBy("page").applyInArrow(mark, "page int, data binary").toLocalIterator():
        out[row.page << 13 : (row.page + 1) << 13] = row.data
    return bytes(out), bits


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(id, key) to id and the compressed text with that key. A broadcast of the keys, if they are few, else a filter of
    bounded size picks the texts on the way out of the scan, so that few others are shuffled."""
    few = wanted.limit(FEW_IDS + 1).count() <= FEW_IDS
    marks, bits = (None, 16) if few else _filter_of(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seen, pack = set(), zstandard.ZstdCompressor(level=3)
        on = None if few else np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            some = batch
            if on is not None:
                spot = batch.column(1).to_numpy()
                some = batch.filter(pa.array((on[spot >> 3] >> (7 - (spot & 7)) & 1).astype(bool)))
            out: tuple[list, list] = ([], [])
            for key, text in zip(some.column(0).to_pylist(), some.column(2), strict=True):
                if key not in seen:
                    seen.add(key)
                    out[0].append(key)
                    out[1].append(pack.compress(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], names=["key", "text"])

    rows = docs.where("text IS NOT NULL").withColumn("key", F.md5("text"))
    if few:
        rows = rows.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    picked = rows.select("key", _spot(F.col("key"), bits).alias("spot"), "text").mapInArrow(tidy(pick), "key string, text binary")
    return picked.join(wanted, "key").groupBy("id").agg(F.min("text").alias("text"))


def _verifier(k: int, t: tuple[int, int]):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingler, unpack = Shingler(k), zstandard.ZstdDecompressor()
        last: tuple = (None, None)
        for batch in batches:
            for some in by_bytes(batch, 3, 1 << 18):
                a, b = some.column(0).to_pylist(), some.column(1).to_pylist()
                others = shingler.sets([unpack.decompress(y) for y in some.column(3).to_pylist()])
                out: tuple[list, list] = ([], [])
                for i, s in enumerate(others):
                    if last[0] != a[i]:
                        last = (a[i], next(shingler.sets([unpack.decompress(some.column(2)[i].as_py())])))
                    if linked(last[1], s, t):
                        out[0].append(a[i])
                        out[1].append(b[i])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return tidy(verify)


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) the ones that link; each is verified on both whole texts. sets(id, key) names a text of each id."""
    wanted = materialise(of_ids(sets.select("id", "key"), ids_of(pairs), 2 * pairs.count()), "jaccard-wanted")
    texts = materialise(_texts(docs, wanted), "jaccard-texts")
    half = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    both = half.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    links = materialise(both.mapInArrow(_verifier(k, t), "a long, b long"), "jaccard-links")
    discard(wanted, texts)
    return links


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to id, comp: of the links of this task, each id's least reachable one."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                top[max(a, b)] = min(a, b)
    ids = list(top)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], names=["id", "comp"])


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to id, comp: the least id that is reachable. Tasks of LINKS links each make forests of theirs. Where there
    are several, labels then fall over these forests to the least neighbour's, and to their label's label, until none
    changes; each round is written to the shared folder."""
    links = materialise(links.select("a", "b"), "links")
    parts = max(1, -(-links.count() // LINKS))
    trees = materialise(links.coalesce(parts).mapInArrow(tidy(_forest), "id long, comp long"), "forests")
    discard(links)
    if parts == 1:
        return trees
    ends = trees.select(F.col("id").alias("a"), F.col("comp").alias("b"))
    edges = materialise(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = materialise(labels, "labels")
    discard(trees)
    while True:
        known = small(labels)
        near = edges.join(known, edges.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        low = near.join(known, labels.id == near.a).select("id", "comp", F.least("comp", "near").alias("low"))
        up = small(labels.select(F.col("id").alias("low"), F.col("comp").alias("top")))
        new = materialise(low.join(up, "low").select("id", F.least("low", "top").alias("new"), "comp"), "labels")
        discard(labels)
        if new.where("new <> comp").isEmpty():
            discard(edges)
            return new.select("id", "comp")
        labels = new.select("id", F.col("new").alias("comp"))


def extended(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps(id, comp) after further links (a, b): the components of the links between components, and the ids that are new."""
    between = _with_ends(links, comps).select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
    trees = components(between)
    top = trees.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    ids = ids_of(links).join(small(comps), "id", "left").select("id", F.coalesce("comp", "id").alias("comp")).unionByName(comps).distinct()
    out = materialise(ids.join(small(top), "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")), "components")
    discard(trees)
    return out


def _with_ends(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with the components ca and cb of their ends."""
    end = lambda name: small(comps.select(F.col("id").alias(name), F.col("comp").alias(f"c{name}")))
    rows = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    return rows.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def _mixed_lists(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """The postings of shingles whose sets are in several components: main is the largest, n_all and n_main the postings of
    the list and of its main component."""
    rows = postings.join(small(comps), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rows = materialise(rows.select("sh", "id", "size", "pos", "comp"), "postings")
    each = rows.groupBy("sh", "comp").agg(F.count(F.lit(1)).alias("n"))
    lists = each.groupBy("sh").agg(F.max(F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_all")).where("k > 1")
    mixed = materialise(rows.join(lists.select("sh", F.col("main.comp").alias("main"), F.col("main.n").alias("n_main"), "n_all"), "sh"), "mixed-lists")
    discard(rows)
    return mixed


def _dealt(mixed: DataFrame) -> DataFrame:
    """Mixed lists, dealt to tasks by (sh, bx, by): SIDE postings outside the main component (side 0), about, against SIDE of
    the whole list (side 1). A list with few members outside goes to each of its tasks once."""
    blocks = lambda n: F.ceil(n / SIDE).cast("int")
    kx, ky = blocks(F.col("n_all") - F.col("n_main")), blocks(F.col("n_all"))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), n - 1)).alias(name)
    own = lambda n, name: F.pmod(F.xxhash64("id"), n).cast("int").alias(name)
    told = ["sh", "id", "size", "pos", "comp", (F.col("comp") == F.col("main")).alias("inside")]
    x = mixed.where("comp <> main").select(*told, own(kx, "bx"), every(ky, "by"), F.lit(0).alias("side"))
    y = mixed.select(*told, every(kx, "bx"), own(ky, "by"), F.lit(1).alias("side"))
    return _by_task(x.unionByName(y))


def _by_task(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "sh", "bx", "by").sortWithinPartitions("sh", "bx", "by")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as one table for each (sh, bx, by)."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sh", "bx", "by")])
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if kept and tuple(key[:, a].tolist()) != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = tuple(key[:, a].tolist())
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


class Side:
    """One list's rows as arrays, and which members of side 1 may link with one of side 0 by size, position and component."""

    def __init__(self, rows: pa.Table):
        self.ids, self.size, self.pos, self.comp, side = (rows[c].to_numpy().astype(np.int64) for c in ("id", "size", "pos", "comp", "side"))
        self.inside = rows["inside"].to_numpy(zero_copy_only=False)
        self.x, self.y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def partners(self, i: int, t: tuple[int, int], of: np.ndarray | None = None, once: bool = True) -> np.ndarray:
        """once: of two members outside the main component only the one of the greater id."""
        at = self.y if of is None else of
        ok = (self.comp[at] != self.comp[i]) & near_enough(self.size[i], self.pos[i], self.size[at], self.pos[at], t)
        return at[ok & (self.inside[at] | (self.ids[at] > self.ids[i]))] if once else at[ok]


LIST = ["kind", "sh", "bx", "by", "side", "id", "size", "pos", "inside", "other"]


def _parted(t: tuple[int, int]):
    """Dealt lists to the pairs between components that pass the filters (kind 0: id and other), if these are no more than
    SPARSE for each row; else to the rows that have such pairs (kind 1)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows in _lists(batches):
            side = Side(rows)
            found, n = {}, 0
            for i in side.x.tolist():
                if len(at := side.partners(i, t)):
                    found[i] = at
                    n += len(at)
            if not n:
                continue
            if n <= SPARSE * rows.num_rows:
                pairs = {(min(a, b), max(a, b)) for i, at in found.items() for a in (int(side.ids[i]),) for b in side.ids[at].tolist()} - seen
                if len(seen) > FEW_IDS:
                    seen.clear()
                seen |= pairs
                a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
                blank = np.zeros(len(pairs), np.int64)
                yield _list_rows(0, blank, blank, blank, blank, a, blank, blank, blank.astype(bool), b)
            else:
                keep = np.unique(np.concatenate([*found.values(), side.x[np.isin(side.x, list(found))]]))
                # in the list both sides hold the members outside the main component, and either may be the one to look
                keep = np.flatnonzero(np.isin(side.ids, side.ids[keep]))
                column = lambda c: rows[c].to_numpy()[keep]  # noqa: B023, E731
                yield _list_rows(1, *(column(c) for c in ("sh", "bx", "by", "side")), side.ids[keep], side.size[keep], side.pos[keep], side.inside[keep], np.zeros(len(keep), np.int64))

    return tidy(part)


def _list_rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True))], names=LIST)


def _folded(marks: np.ndarray) -> np.ndarray:
    half = marks.shape[1] // 2
    return marks[:, :half] ^ marks[:, half:]


def _by_marks(rows: pa.Table, t: tuple[int, int], nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, score) of one list's members of side 0 with ones of side 1, where the filters and the marks let a pair pass:
    each member's likeliest, or all."""
    side = Side(rows)
    raw = rows["marks"].to_pylist()
    wide = np.array([len(m) for m in raw])
    matrix = lambda at, w: np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), w // 8)
    members = {w: (at, matrix(at, w)) for w in np.unique(wide).tolist() for at in (side.y[wide[side.y] == w],)}
    out: list[tuple] = []
    for w in np.unique(wide[side.x]).tolist():
        mine = side.x[wide[side.x] == w]
        marks = matrix(mine, w)
        against = [(*members[w], marks)] if w in members else []
        if w // 2 in members:
            against.append((*members[w // 2], _folded(marks)))
        if 2 * w in members:
            against.append((members[2 * w][0], _folded(members[2 * w][1]), marks))
        for row, i in enumerate(mine.tolist()):
            best: tuple = (-1.0, None)
            for at, theirs, own in against:
                some = side.partners(i, t, at, not nearest)
                if not len(some):
                    continue
                both = side.size[i] + side.size[some]
                apart = np.bitwise_count(theirs[np.searchsorted(at, some)] ^ own[row]).sum(1, dtype=np.int64)
                left = apart <= both - 2 * least_common(side.size[i], side.size[some], t)
                score, some = 1 - apart[left] / both[left], some[left]
                if not len(some):
                    continue
                if nearest:
                    top = int(np.argmax(score))
                    best = max(best, (float(score[top]), int(side.ids[some[top]])), key=lambda x: x[0])
                else:
                    out.append((np.full(len(some), side.ids[i]), side.ids[some], score))
            if best[1] is not None:
                out.append((side.ids[i : i + 1], np.array([best[1]]), np.array([best[0]])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, score = (np.concatenate([o[c] for o in out]) for c in range(3))
    return np.minimum(a, b), np.maximum(a, b), score


def between(dense: DataFrame, comps: DataFrame, sets: DataFrame, t: tuple[int, int], nearest: bool) -> DataFrame:
    """Pairs (a, b, score) between the components of dense lists' rows: of each member outside the main one the likeliest, or
    all that the filters and marks don't refuse."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for rows in _lists(batches):
            a, b, score = _by_marks(rows, t, nearest)
            fresh = [k for k, pair in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if pair not in seen]
            seen.update((int(a[k]), int(b[k])) for k in fresh)
            if len(seen) > FEW_IDS:
                seen.clear()
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh]), pa.array(score[fresh])], names=["a", "b", "score"])

    some = materialise(of_ids(sets.select("id", "marks"), dense.select("id"), dense.count()), "jaccard-marks")
    rows = dense.join(small(comps), "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(some, "id")
    found = materialise(_by_task(rows.select("sh", "bx", "by", "side", "id", "size", "pos", "comp", "inside", "marks")).mapInArrow(tidy(match), "a long, b long, score double"), "jaccard-between")
    discard(some)
    return found


def near_duplicates(docs: DataFrame, k: int = SHINGLE, t: tuple[int, int] = (NUMERATOR, DENOMINATOR)) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id.

    Links: t[1] * |x and y| >= t[0] * |x or y|. A text without words, or null, has an empty set and only itself as its
    component. Rows of equal sets are linked, whatever their ids; repeated rows are kept. component_id is the least
    doc_id of the component; null ids come last and are a component's id only if it has no other. A very long text is
    one set like any other, its words hashed piece by piece. An empty table gives no rows. Other columns are ignored.
    Shingles are compared by 64-bit hashes.
    """
    return _with_components(docs, k, t).select("doc_id", "n_shingles", "component_id")


def _with_components(docs: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """near_duplicates with key, the text's MD5, and comp, its component; both null for texts without words."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    survey = materialise(docs.mapInArrow(_surveyor(k), "block int, doc_id long, id long, n long, data binary, key string, marks binary"), "jaccard-survey")
    members = survey.where("block < 0")
    # different sets with one 64-bit id: next to none at any size that 64 bits number
    clash = members.where("n > 0").groupBy("id").agg(F.min("data").alias("p"), F.max("data").alias("q")).where("p <> q")
    clashing = frozenset(r.id for r in clash.select("id").collect())
    sent = spark.sparkContext.broadcast(_whole_sketch(survey.where("block >= 0").select("block", "data")))
    postings = docs.mapInArrow(_poster(sent, clashing, k, t), "sh long, salt int, id long, size int, pos int")
    share = 1 - t[0] / t[1]
    about = (members.agg(F.sum("n")).first()[0] or 0) * share
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(about / POSTINGS))
    led = materialise(postings.repartition(parts, "sh", "salt").mapInArrow(_leader_pairs(t), "kind int, sh long, a long, b long, size int, pos int"), "jaccard-led")
    del postings
    _release(spark)
    heads = led.where("kind = 2").select("sh", F.col("b").alias("band"), "a", "size")
    over = heads.groupBy("sh", "band").agg(F.min(F.struct("size", "a")).alias("top"))
    across = heads.join(over, ["sh", "band"]).where("a <> top.a").select(F.least("a", "top.a").alias("a"), F.greatest("a", "top.a").alias("b"))
    pairs = materialise(led.where("kind = 0").select("a", "b").unionByName(across).distinct(), "jaccard-pairs")
    own = members.where("n > 0").select("doc_id", "n", _own_id(clashing).alias("id"), "key", "marks")
    sets = materialise(own.groupBy("id").agg(F.min("key").alias("key"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("marks").alias("marks")), "jaccard-sets")
    again = materialise(led.where("kind = 1").select("sh", F.col("a").alias("id"), "size", "pos").distinct(), "jaccard-again")
    scored = likely(pairs, sets, t)
    discard(led)
    _release(spark)
    # each set's likeliest pair; then, between components, the others of these and the likeliest of what mixed lists hold;
    # then whatever is still apart, in full
    seen = first = materialise(best_of_each(scored), "jaccard-seen")
    links = verified(docs, seen, sets, k, t)
    comps = components(links)
    mixed = _mixed_lists(again, comps)
    parted = materialise(_dealt(mixed).mapInArrow(_parted(t), "kind int, sh long, bx int, by int, side int, id long, size int, pos int, inside boolean, other long"), "jaccard-parted")
    discard(again, mixed, links)
    more = parted.where("kind = 0").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialise(more, "jaccard-more")
    passing = [scored, likely(more, sets, t)]
    scored = passing[0].unionByName(passing[1])
    dense = parted.where("kind = 1").select("sh", "bx", "by", "side", "id", "size", "pos", "inside")
    discard(pairs, more)
    _release(spark)
    looked = [first]
    for nearest in (True, False):
        found = between(dense, comps, sets, t, nearest)
        apart = _apart(scored, comps)
        later = best_of_each(apart.unionByName(found)) if nearest else apart.unionByName(found).select("a", "b").distinct()
        later = materialise(later.join(seen, ["a", "b"], "left_anti"), "jaccard-later")
        looked.append(later)
        if not later.isEmpty():
            links, before = verified(docs, later, sets, k, t), comps
            comps = extended(comps, links)
            discard(links, before)
            seen = seen.unionByName(later)
        discard(found)
        _release(spark)
    discard(parted, *passing, *looked)
    least = sets.select("id", "doc_id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = least.select("id", "comp").join(least.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("id", "comp", "component_id")
    full = own.join(named, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "key", "comp")
    return full.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key", F.col("id").alias("comp")))


def _apart(scored: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b, score) whose ends are in different components."""
    return _with_ends(scored, comps).where("ca <> cb").select("a", "b", "score")


def _own_id(clashing: frozenset[int]):
    """A member's id, as _identity gives it."""
    if not clashing:
        return F.col("id")
    digits = F.hex(F.substring("data", 9, 8))
    little = F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8)))
    other = F.conv(little, 16, -10).cast("long")
    return F.when(F.col("id").isin(*clashing), other).otherwise(F.col("id"))


#: A byte that bytes.split() doesn't take for space.
WORDY = r"[^\x20\x09-\x0D]"


def deduplicated(docs: DataFrame, k: int = SHINGLE, t: tuple[int, int] = (NUMERATOR, DENOMINATOR)) -> DataFrame:
    """Of each component one row: the least by doc_id, then by the text's MD5; of rows equal in both, any one.

    Rows without an id go if their component has a row with one; a component of such rows only keeps them all. Texts
    without words, null ones among them, stay. An empty table gives no rows; other columns pass through, whatever they
    are called.
    """
    # a text's MD5 tells its component, so that a row is found again by its id and its text
    each = _with_components(docs, k, t).where("comp IS NOT NULL").groupBy("comp", "doc_id", F.unhex("key").alias("key")).agg((F.count(F.lit(1)) > 1).alias("many"))
    each = materialise(each, "jaccard-rows")
    own, of_id, of_key, many = (unused(docs, name) for name in ("__key", "__id", "__kept", "__many"))
    first = each.where("doc_id IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "key", "many")).alias("first"))
    kept = materialise(first.select(F.col("first.doc_id").alias(of_id), F.col("first.key").alias(of_key), F.col("first.many").alias(many), "comp"), "jaccard-kept")
    gone = materialise(each.where("doc_id IS NULL").join(kept, "comp").select(F.col("key").alias(own)).distinct(), "jaccard-gone")
    discard(each)
    kept = kept.drop("comp")
    rows = docs.withColumn(own, F.unhex(F.md5(F.col("text").cast("binary"))))
    one = lambda of: rows.join(kept.where(of), (rows["doc_id"].cast("long") == kept[of_id]) & (rows[own] == kept[of_key]), "left_semi")
    out = one(~F.col(many))
    if not kept.where(F.col(many)).isEmpty():
        out = out.unionByName(one(F.col(many)).dropDuplicates(["doc_id", own]))
    out = out.unionByName(rows.where("doc_id IS NULL").join(gone, own, "left_anti").select(out.columns))
    wordless = rows.where("doc_id IS NOT NULL").where(F.col("text").isNull() | ~F.col("text").cast("binary").cast("string").rlike(WORDY))
    return out.unionByName(wordless).select(*docs.columns)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT n, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS sh FROM (SELECT n, w, unnest(range(greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT n, count(*) AS size FROM s GROUP BY n),
pairs AS (SELECT a.n AS x, b.n AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.n < b.n GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.n = x JOIN sizes q ON q.n = y WHERE {DENOMINATOR} * common >= {NUMERATOR} * (p.size + q.size - common)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached(n, m) AS (SELECT n, n FROM d UNION SELECT r.n, e.y FROM reached r JOIN edges e ON e.x = r.m)
SELECT d.doc_id, coalesce(size, 0) AS n_shingles, c.component_id FROM d LEFT JOIN sizes USING (n)
JOIN (SELECT r.n, min(o.doc_id) AS component_id FROM reached r JOIN d o ON o.n = r.m GROUP BY r.n) c ON c.n = d.n
"""
