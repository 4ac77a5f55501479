"""SentencePiece encoding and decoding over a relational lattice.

The corpus's words are grouped and counted. The most frequent ones, a bounded number, get a lattice: their substrings
of bounded length are exploded and equi-joined to the piece table, the edges are grouped by word, and a fold of Spark's
higher-order functions walks them. For a unigram model that is the Viterbi fold, which finds the path of greatest
total score; a BPE model defines its result by merges instead (the best-scored adjacent pair first, of equals the
leftmost), so its fold removes one cut at a time. The words' codes are broadcast, their number being bounded, and
texts are put together from them; words beyond them go through the same fold in the worker, many words at once, so the
result does not depend on the bound.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, discard, materialise, table, tidy

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words in the broadcast table, and the longest word in it; words that a worker remembers besides.
FREQUENT, LONGEST, REMEMBERED = 200_000, 40, 300_000
#: Longest word whose pairs are looked through one by one.
SHORT = 64
#: Pieces never hold a space mark after another character, so no piece spans two of these words; where no piece holds a
#: line break, none spans two lines.
WORD, LINED = f"{SPACE}*[^{SPACE}]+|{SPACE}+", f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
EDGE = "array<struct<start: int, end: int, id: int, score: double>>"
UNKNOWN_PENALTY = 10.0
#: Words that are merged side by side.
TOGETHER = 8192


@dataclass
class Pieces:
    """A model's pieces: ids and scores of the normal ones, the id of byte 0 (byte pieces follow each other), all surfaces by id."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte0: int | None
    unknown: int
    surfaces: list[str | int] = field(repr=False)  # a byte's number for byte pieces
    longest: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        normal = [i for i in range(n) if not special[i] and not model.is_byte(i)]
        bytes_at = [i for i in range(n) if model.is_byte(i)]
        surfaces: list[str | int] = [i - bytes_at[0] if model.is_byte(i) else "" if model.is_control(i) else " ⁇ " if model.is_unknown(i) else names[i] for i in range(n)]
        return cls({names[i]: i for i in normal}, {names[i]: model.get_score(i) for i in normal}, bytes_at[0] if bytes_at else None, model.unk_id(), surfaces, max(len(names[i]) for i in normal))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i, float(self.scores[p])) for p, i in self.ids.items()], "piece string, id int, score double")

    def codes(self, symbol: str) -> list[int]:
        """The ids of a symbol that no further merge changes."""
        if symbol in self.ids:
            return [self.ids[symbol]]
        return [self.unknown] if self.byte0 is None else [self.byte0 + b for b in symbol.encode()]

    def merged(self, word: str) -> list[int]:
        """The merge fold of one word: the pair of the greatest score first, of equals the leftmost."""
        if len(word) > SHORT:
            return self._merged_long(word)
        score, none = self.scores.get, -math.inf
        symbols = list(word)
        scores = [score(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(symbols[i - 1] + symbols[i], none)
            if i < len(scores):
                scores[i] = score(symbols[i] + symbols[i + 1], none)
        return [i for s in symbols for i in self.codes(s)]

    def _merged_long(self, word: str) -> list[int]:
        """The same by an agenda of pairs, whose cost is no square of the length."""
        n, score = len(word), self.scores
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts at i: its end, its predecessor
        agenda = [(-score[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in score]
        heapq.heapify(agenda)
        alive = bytearray(b"\1" * n)

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (s := score.get(word[a : end[b]])) is not None:
                heapq.heappush(agenda, (-s, a, end[b]))

        while agenda:
            _, a, c = heapq.heappop(agenda)
            b = end[a] if alive[a] else n
            if b >= n or end[b] != c:
                continue  # one of the two has been merged since
            alive[b] = 0
            end[a] = c
            if c < n:
                back[c] = a
                offer(a)
            if back[a] >= 0:
                offer(back[a])
        out, at = [], 0
        while at < n:
            out += self.codes(word[at : end[at]])
            at = end[at]
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids; the space that encoding puts in front is taken off. Broken UTF-8 becomes U+FFFD."""
        at = np.asarray(ids, np.int32)
        parts = list(map(self.surfaces.__getitem__, at.tolist()))
        if self.byte0 is not None and ((at >= self.byte0) & (at < self.byte0 + 256)).any():
            text = b"".join(bytes((p,)) if type(p) is int else p.encode() for p in parts).decode(errors="replace")
        else:
            text = "".join(parts)
        return text.replace(SPACE, " ").removeprefix(" ")


class Merger:
    """The merge fold of many words side by side. Symbols are numbered: pieces, and characters that pieces hold."""

    def __init__(self, pieces: Pieces):
        symbols = {p: k for k, p in enumerate(dict.fromkeys([*pieces.ids, *(c for p in pieces.ids for c in p)]))}
        self.pieces, self.n = pieces, len(symbols)
        self.code = np.array([pieces.ids.get(p, -1) for p in symbols], np.int32)  # -1: a character that is no piece
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.n  # no part of any piece
        for p, k in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        self.chars = {k: p for p, k in symbols.items() if p not in pieces.ids}
        pairs = {}
        for p, score in pieces.scores.items():
            for i in range(1, len(p)):
                left, right = symbols.get(p[:i]), symbols.get(p[i:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = (score, symbols[p])
        self.keys = np.array(sorted(pairs), np.int64)
        # the last of each is for no pair
        self.made = np.array([*(pairs[k][1] for k in self.keys.tolist()), -1], np.int32)
        scores = np.array([pairs[k][0] for k in self.keys.tolist()])
        self.rank = np.append(np.unique(scores, return_inverse=True)[1], -1).astype(np.int32) if len(scores) else np.array([-1], np.int32)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The numbers of pairs of symbols, -1 where they don't merge."""
        if not len(self.keys):
            return np.full(left.shape, -1)
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0) & (right < self.n), at, -1)

    def merged(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of words of at most SHORT characters."""
        out: dict[str, bytes] = {}
        words = sorted(words, key=len)
        for low in range(0, len(words), TOGETHER):
            out |= self._together(words[low : low + TOGETHER])
        return out

    def _together(self, words: list[str]) -> dict[str, bytes]:
        size = np.array([len(w) for w in words])
        width = int(size.max()) + 1
        symbols = np.full((len(words), width), -1, np.int32)
        symbols[np.arange(width)[None, :] < size[:, None]] = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        done = symbols.copy()
        pair = self._pair(symbols[:, :-1], symbols[:, 1:])
        left, columns = np.arange(len(words)), np.arange(width)
        while len(left):
            rank = self.rank[pair]
            best = rank.argmax(1)  # of equals the leftmost
            row = np.arange(len(left))
            more = rank[row, best] >= 0
            done[left[~more]] = symbols[~more]
            left, symbols, pair, best = left[more], symbols[more], pair[more], best[more]
            row = np.arange(len(left))
            symbols[row, best] = self.made[pair[row, best]]
            after = np.minimum(columns + (columns > best[:, None]), width - 1)  # the symbol after the merged one goes
            symbols = np.take_along_axis(symbols, after, 1)
            symbols[:, -1] = -1
            pair = np.take_along_axis(pair, after[:, :-1].clip(max=width - 2), 1)
            pair[:, -1] = -1
            pair[row, best] = self._pair(symbols[row, best], symbols[row, best + 1])
            back = best > 0
            pair[row[back], best[back] - 1] = self._pair(symbols[row[back], best[back] - 1], symbols[row[back], best[back]])
            size[left] -= 1
        kept = columns[None, :] < size[:, None]
        known = (done >= 0) & (done < self.n)
        codes = np.where(known, self.code[np.where(known, done, 0)], -1).astype("<i4")
        whole = ((codes >= 0) | ~kept).all(1)
        raw, step = codes.tobytes(), 4 * width
        out = {w: raw[k * step : k * step + 4 * n] for k, (w, n) in enumerate(zip(words, size.tolist(), strict=True))}
        for k in np.flatnonzero(~whole).tolist():
            ids: list[int] = []
            for symbol, code in zip(done[k, : size[k]].tolist(), codes[k].tolist(), strict=False):
                ids += [code] if code >= 0 else self.pieces.codes(chr(symbol - self.n) if symbol >= self.n else self.chars[symbol])
            out[words[k]] = packed(ids)
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """How often words stand after a space, with a space mark in front, and at the beginning of a line but the first, without."""
    cut = F.split(F.replace("text", F.lit("\n"), F.lit(" \n")), " ")
    words = docs.select(F.explode(cut).alias("w")).where("length(w) > 0 AND w <> '\\n'").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return words.select(F.when(F.col("w").startswith("\n"), F.substring("w", 2, 1 << 30)).otherwise(F.concat(F.lit(SPACE), "w")).alias("word"), "n")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """words(word) to word, edges: one for each substring that is a piece. The piece table's size is the model's."""
    spans = F.expr(f"explode(flatten(transform(sequence(0, length(word) - 1), s -> transform(sequence(1, least({longest}, length(word) - s)), n -> struct(s AS start, s + n AS end)))))")
    subs = words.where(F.length("word") > 0).select("word", spans.alias("span")).withColumn("piece", F.expr("substring(word, span.start + 1, span.end - span.start)"))
    edges = subs.join(F.broadcast(pieces), "piece").select("word", F.struct("span.start", "span.end", "id", "score").alias("edge"))
    found = edges.groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return words.join(found, "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast(EDGE)))


def _spelled(byte0: int | None, unknown: int) -> tuple[str, str]:
    """SQL of the ids between cuts a and b: the edge's piece if there is one; else the bytes of the one character."""
    if byte0 is None:
        rest = f"array({unknown})"
    else:
        code = "hex(encode(substring(word, a + 1, b - a), 'UTF-8'))"
        rest = f"transform(sequence(0, CAST(length({code}) / 2 AS INT) - 1), i -> {byte0} + CAST(conv(substring({code}, 2 * i + 1, 2), 16, 10) AS INT))"
    return f"coalesce(transform(slice(filter(edges, e -> e.start = a AND e.end = b), 1, 1), e -> e.id), array())", rest


def merge_fold(byte0: int | None, unknown: int) -> str:
    """SQL over word and edges to ids: as many steps as there are inner cuts, each removing the best pair's one."""
    pair = "get(cuts, CAST(array_position(cuts, e.start) AS INT) + 1) = e.end AND array_contains(cuts, e.start)"
    best = f"array_max(transform(filter(edges, e -> {pair}), e -> struct(e.score AS score, -e.start AS left, e.end AS end)))"
    step = f"element_at(transform(array({best}), p -> IF(p IS NULL, cuts, filter(cuts, c -> c <= -p.left OR c >= p.end))), 1)"
    own, rest = _spelled(byte0, unknown)
    ids = f"element_at(transform(array({own}), x -> IF(size(x) > 0, x, {rest})), 1)"
    bound = f"element_at(transform(array(struct(cuts[k] AS a, cuts[k + 1] AS b)), t -> element_at(transform(array(t.a), a -> element_at(transform(array(t.b), b -> {ids}), 1)), 1)), 1)"
    out = f"flatten(transform(sequence(0, size(cuts) - 2), k -> {bound}))"
    return f"aggregate(sequence(1, length(word)), sequence(0, length(word)), (cuts, step) -> {step}, cuts -> {out})"


def viterbi_fold(unknown: int, unknown_score: float) -> str:
    """SQL over word and edges to ids of the path with the greatest sum of scores; of equals, the longer last piece wins.

    A character that no piece covers is an edge of its own, of the unknown piece.
    """
    best = "struct(CAST(0 AS DOUBLE) AS total, 0 AS back, CAST(-1 AS INT) AS id)"
    reach = "transform(filter(edges, e -> e.end = j), e -> struct(s[e.start].total + e.score AS total, -e.start AS near, e.start AS back, e.id AS id))"
    alone = f"IF(exists(edges, e -> e.end = j AND e.start = j - 1), array(), array(struct(s[j - 1].total + {unknown_score!r}D AS total, 1 - j AS near, j - 1 AS back, {unknown} AS id)))"
    top = f"element_at(transform(array(array_max(concat({reach}, {alone}))), m -> struct(m.total AS total, m.back AS back, m.id AS id)), 1)"
    walk = "aggregate(sequence(1, size(s)), struct(size(s) - 1 AS at, CAST(array() AS ARRAY<INT>) AS ids), (w, i) -> IF(w.at <= 0, w, struct(s[w.at].back AS at, concat(array(s[w.at].id), w.ids) AS ids)), w -> w.ids)"
    return f"aggregate(sequence(1, length(word)), array({best}), (s, j) -> concat(s, array({top})), s -> {walk})"


def word_codes(words: DataFrame, pieces: Pieces, fold: str = "merge") -> DataFrame:
    """words(word) to word, ids. fold: merge for BPE models, viterbi for unigram ones."""
    least = min(pieces.scores.values(), default=0.0)
    sql = merge_fold(pieces.byte0, pieces.unknown) if fold == "merge" else viterbi_fold(pieces.unknown, least - UNKNOWN_PENALTY)
    return lattice(words, pieces.table(words.sparkSession), pieces.longest).select("word", F.expr(sql).alias("ids"))


def frequent_words(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The words of at most LONGEST characters that occur more often than some count: as many as fit in `frequent`.

    The count is found from a histogram in steps of a 64th of a doubling, a few thousand rows whatever the corpus.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    counts = materialise(word_counts(docs).where(F.length("word") <= LONGEST).select("word", step.alias("step")), "word-counts")
    least, room = None, frequent
    for row in counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect():
        if row.n > room:
            break
        least, room = row.step, room - row.n
    return counts.where(F.lit(False) if least is None else F.col("step") >= least).select("word")


def frequent_codes(docs: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> dict[str, bytes]:
    """The codes of the frequent words, by word."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = frequent_words(docs, frequent)
    rows = word_codes(words.repartition(parts, "word"), pieces).toArrow()
    discard(words)
    return {w: packed(ids) for w, ids in zip(rows["word"].to_pylist(), rows["ids"].to_pylist(), strict=True)}


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit integers, least byte first."""
    return np.array(ids, "<i4").tobytes()


#: A line break, named.
BREAK = SPACE + "\n"


class Encoder:
    """Texts to packed ids. A word's codes are looked up; rarer words of some texts are merged together, once, and remembered
    for a while. Words are named without their space mark if they begin with one only, else with one more."""

    def __init__(self, pieces: Pieces, known: dict[str, bytes], merger: Merger):
        """known: the codes of named words."""
        self.pieces, self.merger, self.known, self.codes = pieces, merger, known, dict(known)
        self.lined = not any("\n" in p for p in pieces.ids)

    def _words(self, text: str | None) -> list[str]:
        """The named words of a text, in order."""
        if not text:
            return []
        if SPACE not in text:
            lines = [line.split(" ") for line in text.split("\n")] if self.lined else [text.split(" ")]
            if not any("" in words for words in lines):
                out = lines[0]
                for words in lines[1:]:
                    out.append(BREAK)
                    out.append(SPACE + words[0])
                    out += words[1:]
                return out
        return list(map(named, re.findall(LINED if self.lined else WORD, SPACE + text.replace(" ", SPACE))))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.codes) > len(self.known) + REMEMBERED:
            self.codes = dict(self.known)
        codes = self.codes
        split = [self._words(t) for t in texts]
        missing = {w for words in split for w in words if w not in codes}
        whole = {w: w[1:] if w[:1] == SPACE else SPACE + w for w in missing}
        fold = self.merger.merged([x for x in whole.values() if len(x) <= SHORT])
        for w, x in whole.items():
            codes[w] = fold[x] if x in fold else packed(self.pieces.merged(x))
        out = [b"".join(map(codes.__getitem__, words)) for words in split]
        for w in missing:
            if len(w) > LONGEST:
                del codes[w]
        return out


def named(word: str) -> str:
    return word[1:] if word[:1] == SPACE and word[1:2] != SPACE else SPACE + word


def _encoder(docs: DataFrame, pieces: Pieces, frequent: int):
    """What makes an Encoder in a worker. Broadcasts hold plain values only: unlike functions, their classes don't travel."""
    folds = {name: value for name, value in vars(Merger(pieces)).items() if name != "pieces"}
    codes = {named(w): ids for w, ids in frequent_codes(docs, pieces, frequent).items()}
    sent = docs.sparkSession.sparkContext.broadcast((vars(pieces), codes, folds))

    def get() -> Encoder:
        own, known, folds = sent.value
        own, merger = Pieces(**own), Merger.__new__(Merger)
        merger.__dict__.update(folds, pieces=own)
        return Encoder(own, known, merger)

    return get


def encoded(docs: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> DataFrame:
    """docs with two further columns, ids array<int> and n_pieces int.

    A null or empty text has no ids. Repeated rows and null ids are kept, an empty table gives no rows; all columns pass
    through, but for ones named ids or n_pieces, which are replaced. A text holding the space mark itself is
    encoded as with a space in its place. A very long text is encoded whole.
    """
    docs = docs.drop("ids", "n_pieces")
    get, at = _encoder(docs, pieces, frequent), docs.columns.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            for some in by_bytes(batch, at):
                ids = encoder(some.column(at).to_pylist())
                sizes = np.fromiter((len(i) // 4 for i in ids), np.int32, len(ids))
                flat = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*some.columns, lists, pa.array(sizes)], names=[*some.schema.names, "ids", "n_pieces"])

    return docs.mapInArrow(tidy(encode), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType())]))


def decoded(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """rows(..., ids) with a further column decoded, which replaces one of that name; null ids give null. Repeated rows are
    kept, an empty table gives no rows."""
    rows = rows.drop("decoded")
    sent, at = rows.sparkSession.sparkContext.broadcast(vars(pieces)), rows.columns.index("ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(**sent.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                texts = [None if i is None else own.decode(i) for i in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*some.schema.names, "decoded"])

    return rows.mapInArrow(tidy(decode), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def coded(docs: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_pieces, ids_sha256 (of the ids as 32-bit integers, least byte first) and restored: whether decoding
    gives the text again (null: the empty one), the space mark standing for a space.

    Repeated rows and null ids are kept, an empty table gives no rows, other columns are ignored, and a very long text is
    encoded whole.
    """
    get = _encoder(docs, pieces, frequent)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for batch in batches:
            for some in by_bytes(batch, 1):
                texts = some.column(1).to_pylist()
                ids = encoder(texts)
                same = [encoder.pieces.decode(np.frombuffer(i, "<i4")) == (t or "").replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                cols = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([some.column(0), *cols], names=["doc_id", "n_pieces", "ids_sha256", "restored"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(code), "doc_id long, n_pieces long, ids_sha256 string, restored boolean")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"), Pieces.load(model_path()))
