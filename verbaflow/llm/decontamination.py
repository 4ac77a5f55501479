"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of all benchmark items. A document's words are streamed through it, keeping the
length of the longest match that ends at each word. Where that length reaches the window, the last words are a window
of some item; where the match ends in a whole item that is shorter than the window, so are that item's words. A benchmark
of more than BLOCK_WORDS words is dealt to blocks of bounded size, an automaton each. Neither the driver nor a task holds
more than one: texts are read once for each block, and what several blocks find in a text is joined by its digest.
Texts are matched one after the other, a long one piece by piece with the automaton's state carried on, so that a task
holds the words of one piece only.
"""

from __future__ import annotations

import functools
import hashlib
import math
import pickle
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, discard, materialise, table, tidy, unused

WINDOW = 10
#: Words of benchmark items in one automaton.
BLOCK_WORDS = 200_000
#: Share of hit words from which a document goes as a whole.
COVERAGE = 0.8
#: On UTF-8 bytes in ASCII lower case; every byte of a character beyond ASCII belongs to a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of a text whose words are held at once, about.
PIECE = 1 << 19
#: Bytes for which a word weighs one more.
LONG_WORD = 32
#: Rows without texts, or texts with hits, that are broadcast to be joined; counted before.
FEW_ROWS = 100_000
SUMMARY = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
SUMMARY_TYPES = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def pieces_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; no word is cut."""
    low = (text or b"").lower()
    at = 0
    while at < len(low):
        gap = GAP.search(low, at + PIECE) if at + PIECE < len(low) else None
        end = gap.start() if gap else len(low)
        yield WORD.findall(low, at, end)
        at = end


class Automaton:
    """Generalised suffix automaton of word sequences; items: [(item id, words)]."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int | None, int]] = []  # (state, item, number of words up to it)
        whole: dict[int, set[int]] = {}
        for item, words in items:
            last = 0
            for n, word in enumerate(words, 1):
                last = self._add(last, word)
                if n >= window:
                    ends.append((last, item, n))
            if 0 < len(words) < window:
                whole.setdefault(last, set()).add(item)
        # For the shortest state whose matches reach the window, the items that hold that window: they reach it by links.
        self.items: dict[int, set[int]] = {}
        for state, item, _ in ends:
            self.items.setdefault(self._at_window(state), set()).add(item)
        # Short items end at the state's longest match: only the state whose length equals the item's has it.
        self.whole = {s: (self.len[s], ids) for s, ids in whole.items()}
        self.vocabulary = {w for _, words in items for w in words}
        self.short_link = self._short_links()
        self.least = min([window, *(n for n, _ in self.whole.values())])

    def _add(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(word)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._split(last, word, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return cur

    def _split(self, p: int, word: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def _at_window(self, state: int) -> int:
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _short_links(self) -> list[int]:
        """For every state, the nearest state on its link path (itself included) that ends a short item, else 0."""
        out = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            out[s] = s if s in self.whole else out[self.link[s]]
        return out

    def hits(self, pieces: Iterable[list[bytes]]) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Of a text's words, in pieces: their number, the hit ranges in order of their ends, and the items whose windows occur."""
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        known = self.vocabulary
        before, carry = 0, (0, 0)
        for words in pieces:
            at, n = 0, len(words)
            flags = [w in known for w in words]
            while at < n:
                if not flags[at]:
                    carry = (0, 0)
                    try:
                        at = flags.index(True, at)
                    except ValueError:
                        break
                try:
                    end = flags.index(False, at)
                except ValueError:
                    end = n
                if end == n or carry[1] + end - at >= self.least:
                    carry = self._run(words, at, end, before, carry, found, items)
                at = end
            before += n
        return before, found, items

    def _run(self, words: list[bytes], at: int, end: int, before: int, carry: tuple[int, int], found: list, items: set[int]) -> tuple[int, int]:
        """Matches words[at:end], of which `before` words precede the first, from a state and its matched length to the next."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state, matched = carry
        for i in range(at, end):
            word = words[i]
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            here = before + i + 1
            if matched >= window:
                found.append((here - window, here))
                items |= self.items[self._at_window(state)]
            # a state's shorter matches end the items that its link path ends; its own longest may exceed the match
            short = self.short_link[state]
            while short:
                size, ids = self.whole[short]
                if size <= matched:
                    found.append((here - size, here))
                    items |= ids
                short = self.short_link[link[short]]
        return state, matched


def item_pieces(window: int, most: int):
    """(item, text) to item, words (joined by spaces) and weight: whole items, or where one weighs more than `most`, pieces that
    overlap by a word less than the window, so that each window is in one of them. A word weighs 1, a long one more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, start = words_of(text), 0
                weights = [1 + len(w) // LONG_WORD for w in words]
                while start < len(words):
                    end, weight = start, 0
                    while end < len(words) and (weight + weights[end] <= most or end - start < window):
                        weight += weights[end]
                        end += 1
                    cols = [pa.array([item], pa.string()), pa.array([b" ".join(words[start:end])], pa.binary()), pa.array([weight], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["item", "words", "weight"])
                    start = end - window + 1 if end < len(words) else end

    return tidy(cut)


class Blocks:
    """The benchmark's items in the shared folder, dealt to blocks of bounded weight by hash; the driver holds one at a time."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, window: int, block_words: int):
        self.spark, self.window = spark, window
        items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).distinct()
        self.pieces = materialise(items.mapInArrow(item_pieces(window, max(block_words // 8, window)), "item string, words binary, weight long"), "benchmark-items")
        total = self.pieces.agg(F.sum("weight")).first()[0] or 0
        self.n = 1 if total <= block_words else math.ceil(total / (0.6 * block_words))
        while self.n > 1 and self._heaviest() > max(1.25 * block_words, 4 * window):
            self.n *= 2

    def _block(self):
        return F.pmod(F.xxhash64("item", "words"), F.lit(self.n))

    def _heaviest(self) -> int:
        return self.pieces.groupBy(self._block().alias("block")).agg(F.sum("weight").alias("weight")).agg(F.max("weight")).first()[0]

    def sent(self, k: int):
        """A broadcast of one block's items, and whether it has any."""
        rows = self.pieces.where(self._block() == k).select("item", "words").toLocalIterator()
        items = [(row.item, bytes(row.words).split(b" ")) for row in rows]
        return self.spark.sparkContext.broadcast(pickle.dumps(items)), bool(items)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matcher(items, window: int):
    """A function of texts that gives of each the number of its words, its merged hit ranges and its items. items: a broadcast
    of a block's pickled items, whose automaton is made when the first text comes."""
    kept: list[Automaton] = []

    def match(texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
        if not kept:
            kept.append(Automaton(pickle.loads(items.value), window))
        found = (kept[0].hits(pieces_of(text)) for text in texts)
        return [(n, merged(ranges), ids) for n, ranges, ids in found]

    return match


def few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are FEW_ROWS or fewer."""
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


def digest(text):
    """What stands for a text where rows of several blocks meet."""
    return F.unhex(F.md5(text.cast("binary")))


def hits_of_all(texts: DataFrame, blocks: Blocks) -> DataFrame:
    """texts(key, text) to key, ranges (first, end, first, end, ...) and items of each text with hits, which are those in any of
    several blocks. Texts are read once for each block; only hits are written."""

    def hit(items):
        match = matcher(items, blocks.window)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in by_bytes(batch, 1):
                    found = match(some.column(1).to_pylist())
                    at = [i for i, (_, ranges, _) in enumerate(found) if ranges]
                    ranges = [[x for r in found[i][1] for x in r] for i in at]
                    items = [sorted(found[i][2], key=str) for i in at]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["key", "ranges", "items"])

        return tidy(find)

    parts = []
    for k in range(blocks.n):
        items, some = blocks.sent(k)
        if some:
            parts.append(materialise(texts.mapInArrow(hit(items), "key binary, ranges array<long>, items array<string>"), "benchmark-hits"))
        items.unpersist()
    all_of = lambda c: F.flatten(F.collect_set(c)).alias(c)
    found = materialise(functools.reduce(DataFrame.unionByName, parts).groupBy("key").agg(all_of("ranges"), all_of("items")), "benchmark-found")
    discard(*parts)
    return found


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return merged(list(zip(flat[::2], flat[1::2], strict=True)))


def _summary(n: int, ranges: list[tuple[int, int]], items: set) -> tuple:
    ids = ",".join(sorted(str(i) for i in items if i is not None))
    n_hit = sum(b - a for a, b in ranges)
    return n, n_hit, len(items), hashlib.sha256(ids.encode()).hexdigest(), n_hit > 0


def _summaries(first: pa.Array, of: list[tuple], name: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    cols = [pa.array([s[i] for s in of], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([first, *cols], names=[name, *SUMMARY])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits, its items_sha256 is that of the empty string. Items that are null
    or without words hit nothing; an item id with several texts counts once. Items without an id hit like others and
    count as one in n_items, as in OP9_SQL, but items_sha256 has no id of theirs. Repeated rows and null ids
    are kept. An empty table on either side gives no rows, or rows without hits. Other columns are ignored.
    """
    blocks = Blocks(docs.sparkSession, benchmark, window, block_words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if blocks.n > 1:
        return _by_several(rows, blocks)
    match = matcher(blocks.sent(0)[0], window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, 1):
                yield _summaries(some.column(0), [_summary(*found) for found in match(some.column(1).to_pylist())], "doc_id")

    return rows.mapInArrow(tidy(count), f"doc_id long, {SUMMARY_TYPES}")


def _by_several(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """contamination by several blocks: each row's number of words, joined to what its text's hits come to."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, 1):
                n = [sum(map(len, pieces_of(t))) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), some.column(2)], names=["doc_id", "n_words", "key"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield _summaries(batch.column(0), [_summary(0, _pairs(ranges), set(items)) for ranges, items in of], "key")

    keyed = rows.withColumn("key", digest(F.col("text")))
    found = hits_of_all(keyed.where("text IS NOT NULL").select("key", "text"), blocks)
    sums = few(found.mapInArrow(tidy(sum_up), f"key binary, {SUMMARY_TYPES}").drop("n_words"))
    none = dict(zip(SUMMARY, _summary(0, [], set()), strict=True))
    out = keyed.mapInArrow(tidy(count), "doc_id long, n_words long, key binary").join(sums, "key", "left")
    return out.select("doc_id", "n_words", *(F.coalesce(c, F.lit(none[c])).alias(c) for c in SUMMARY[1:]))


def cleaned_text(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each of the merged ranges."""
    out, at, left = [], 0, iter(ranges)
    first, last = next(left)
    for n, m in enumerate(WORD.finditer(text.lower())):
        if n == first:
            out.append(text[at : m.start()])
        if n == last - 1:
            at = m.end()
            first, last = next(left, (-1, -1))
            if first < 0:
                break
    return b"".join([*out, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with hit spans cut out of text; documents whose hit words are `coverage` or more of all words go.

    Where a cut brings words together that make a window again, that is cut too, until the text has no hit. All columns
    are kept as they are, but for text and, where there is one, n_chars, which follows the text. Documents without hits,
    null and empty texts among them, are unchanged. Null ids and repeated rows are kept.
    """
    blocks = Blocks(docs.sparkSession, benchmark, window, block_words)
    if blocks.n > 1:
        return _counted_again(docs, _cut_by_several(docs, blocks, coverage))
    match = matcher(blocks.sent(0)[0], window)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, at):
                texts = some.column(at).cast(pa.binary()).to_pylist()
                found = match(texts)
                keep = [not r or sum(b - a for a, b in r) < coverage * n for n, r, _ in found]
                hit = [k for k, (_, r, _) in enumerate(found) if r and keep[k]]
                if not hit:
                    yield some.filter(pa.array(keep, pa.bool_()))
                    continue
                left = {k: found[k][1] for k in hit}
                while left:
                    for k, ranges in left.items():
                        texts[k] = cleaned_text(texts[k], ranges)
                    left = {k: r for k, (_, r, _) in zip(left, match([texts[k] for k in left]), strict=True) if r}
                column = pa.array(texts, pa.binary()).cast(some.schema.field(at).type)
                yield some.set_column(at, some.schema.field(at), column).filter(pa.array(keep, pa.bool_()))

    return _counted_again(docs, docs.mapInArrow(tidy(clean), docs.schema))


def _counted_again(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def _cutter(coverage: float | None):
    """(key, text, ranges) to key and the text without ranges, or null for one of which they are `coverage` or more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, 1):
                left = []
                for text, flat in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    ranges = _pairs(flat)
                    goes = coverage is not None and sum(b - a for a, b in ranges) >= coverage * sum(map(len, pieces_of(text)))
                    left.append(None if goes else cleaned_text(text, ranges))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(left, pa.binary())], names=["key", "text"])

    return tidy(cut)


def _cut_by_several(docs: DataFrame, blocks: Blocks, coverage: float) -> DataFrame:
    """decontaminated by several blocks: the texts with hits are cut in rounds, one of each, and joined to their rows. Where
    more than FEW_ROWS texts have hits, whole rows are shuffled for that."""
    own, of, new = (unused(docs, name) for name in ("__key", "__of", "__new"))
    texts = docs.where("text IS NOT NULL").select(digest(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    changed: DataFrame | None = None
    while True:
        hits = hits_of_all(texts, blocks)
        if hits.isEmpty():
            break
        # a text's key stays the one that it had first
        some = texts.join(few(hits.select("key")), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
        cut = some.join(hits, "key").select("key", "text", "ranges")
        cut = materialise(cut.mapInArrow(_cutter(coverage if changed is None else None), "key binary, text binary"), "benchmark-cut")
        discard(hits)
        changed = cut if changed is None else materialise(changed.join(cut.select("key"), "key", "left_anti").unionByName(cut), "benchmark-cut")
        texts = cut.where("text IS NOT NULL")
    if changed is None:
        return docs
    keyed = docs.withColumn(own, digest(F.col("text")))
    keys = few(changed.select(F.col("key").alias(of)))
    kept = keyed.join(keys, keyed[own] == keys[of], "left_anti")
    left = changed.where("text IS NOT NULL").select(F.col("key").alias(of), F.col("text").cast(docs.schema["text"].dataType).alias(new))
    again = keyed.join(keys, keyed[own] == keys[of], "left_semi").join(left, F.col(own) == F.col(of)).withColumn("text", F.col(new))
    return kept.select(docs.columns).unionByName(again.select(docs.columns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT item_id, w, least({WINDOW}, len(w)) AS size FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i + 1 : i + size], ' ') AS win FROM (SELECT *, unnest(range(len(w) - size + 1)) AS i FROM items)),
sizes AS (SELECT DISTINCT size FROM items),
spots AS (SELECT n, size, i, array_to_string(w[i + 1 : i + size], ' ') AS win FROM (SELECT n, size, w, unnest(range(len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT s.n, s.size, s.i, x.item_id FROM spots s JOIN windows x ON x.size = s.size AND x.win = s.win),
covered AS (SELECT n, count(DISTINCT at_word) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS at_word FROM hits) GROUP BY n),
named AS (SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY n)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (n) LEFT JOIN named USING (n)
"""
