"""A part-of-speech tagger that is learned: a hidden Markov model over symbols of words.

A word's symbol is itself if it is one of the most frequent, else what its shape and ending say, so that a model has a
bounded number of symbols and fits every executor. The first model is that of counts under any plain tagger; rounds of
expectation-maximisation fit it to the texts: tasks run forward-backward over Arrow batches and return expected
counts, Spark adds them, the driver divides. Decoding goes through many sequences at once, in whole numbers,
thousandths of logarithms, so that it gives the same tags everywhere; of equal paths the one with the earlier tags wins.
Sequences that are read many times are kept in the shared folder, so that texts are tokenized and decoded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokenize import tokenize
from ..streaming.texts import shared_folder
from .stem import baseline_tag, stems

TAGS = (".", "CC", "CD", "DT", "IN", "JJ", "MD", "NN", "NNP", "NNS", "PRP", "RB", "SYM", "TO", "VBD", "VBG")
#: The tag of what a plain tagger has no tag of TAGS for.
OTHER_TAG = "SYM"
ENDINGS = ("ing", "ed", "ly", "est", "er", "tion", "s")
SHAPES = ("number", "mark", "capital", *("-" + e for e in ENDINGS), "other")
#: Most frequent words that are symbols of their own.
FREQUENT = 300
#: Tokens of a sequence, at most; longer texts go on in a new one, as analyzers cut overlong sentences.
MOST_TOKENS = 1000
#: The score of what a model holds to be impossible.
NEVER = -40_000
#: Sequences of forward-backward at once.
BATCH = 256


def frequent_words(tokens: DataFrame, most: int = FREQUENT) -> list[str]:
    """The `most` most frequent of tokens(token) in lower case, in their order; of equals the first by code points."""
    words = tokens.groupBy(F.lower("token").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return [r.word for r in words.orderBy(F.col("n").desc(), "word").limit(most).collect()]


def symbol(token: Column, frequent: list[str]) -> Column:
    low = F.lower(token)
    shape = F.when(token.rlike(r"^[\p{N}.,]*\p{N}[\p{N}.,]*$"), "number").when(~token.rlike(r"[\p{L}\p{N}]"), "mark").when(token.rlike(r"^\p{Lu}"), "capital")
    for ending in ENDINGS:
        shape = shape.when(low.endswith(ending), "-" + ending)
    return F.when(low.isin(*frequent), F.concat(F.lit("="), low)).otherwise(shape.otherwise("other"))


def symbols(frequent: list[str]) -> list[str]:
    return [*SHAPES, *("=" + w for w in frequent)]


def sequences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs(key, text) to key, at, tokens: a text's tokens, MOST_TOKENS in a row; at is the place of the first. Texts without tokens have no rows."""
    toks = tokenize(F.col("text"))
    cut = F.transform(F.array(toks), lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / MOST_TOKENS)), lambda i: F.struct((i * MOST_TOKENS).cast("int").alias("at"), F.slice(t, (i * MOST_TOKENS + 1).cast("int"), MOST_TOKENS).alias("tokens"))))
    return docs.select(key, F.explode(F.element_at(cut, 1)).alias("c")).where(F.size("c.tokens") > 0).select(key, "c.at", "c.tokens")


def kept(rows: DataFrame, label: str) -> DataFrame:
    """rows, written to the shared folder and read from there."""
    path = shared_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass
class Hmm:
    """Probabilities: start[tag], transition[tag, next tag], emission[tag, symbol]."""

    frequent: list[str]
    start: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    tags: tuple[str, ...] = TAGS

    def scores(self) -> tuple[list[int], list[int], list[int]]:
        """Thousandths of logarithms: start, transitions by tag and next tag, emissions by symbol and tag."""
        with np.errstate(divide="ignore"):
            whole = lambda p: np.maximum(np.floor(1000 * np.log(p) + 0.5), NEVER).astype(int).ravel().tolist()
            return whole(self.start), whole(self.transition), whole(self.emission.T)


def counted(rows: DataFrame, frequent: list[str], tagger: Callable[[Column], Column] = baseline_tag, tags: tuple[str, ...] = TAGS) -> Hmm:
    """The model of rows(tokens) under a tagger of single tokens: relative frequencies, with one added to each count."""
    names = symbols(frequent)
    tag = lambda t: F.coalesce(F.when(tagger(t).isin(*tags), tagger(t)), F.lit(OTHER_TAG))
    both = F.transform("tokens", lambda t: F.struct(tag(t).alias("tag"), symbol(t, frequent).alias("symbol")))
    entry = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    def entries(ts: Column) -> Column:
        first = F.array(entry("start", ts[0]["tag"], F.lit("")))
        moves = F.transform(F.slice(ts, 1, F.size(ts) - 1), lambda t, i: entry("move", t["tag"], F.get(ts, i + 1)["tag"]))
        return F.concat(first, moves, F.transform(ts, lambda t: entry("word", t["tag"], t["symbol"])))

    every = F.element_at(F.transform(F.array(both), entries), 1)
    found = rows.select(F.explode(every).alias("e")).groupBy("e.kind", "e.a", "e.b").agg(F.count(F.lit(1)).alias("n")).collect()  # as many as the model has entries, at most
    at, symbol_at = {t: i for i, t in enumerate(tags)}, {s: i for i, s in enumerate(names)}
    start, move, word = np.ones(len(tags)), np.ones((len(tags), len(tags))), np.ones((len(tags), len(names)))
    for r in found:
        if r.kind == "start":
            start[at[r.a]] += r.n
        elif r.kind == "move":
            move[at[r.a], at[r.b]] += r.n
        else:
            word[at[r.a], symbol_at[r.b]] += r.n
    return Hmm(frequent, start / start.sum(), move / move.sum(1, keepdims=True), word / word.sum(1, keepdims=True), tags)


def expected(model: Hmm, seqs: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood and expected counts of starts, transitions and emissions, by forward-backward over many sequences at once."""
    k = len(model.start)
    like, start, move, word = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(model.emission.shape)
    seqs = sorted((s for s in seqs if len(s)), key=len, reverse=True)
    for low in range(0, len(seqs), BATCH):
        some = seqs[low : low + BATCH]
        size = np.array([len(s) for s in some])
        longest = size[0]
        o = np.zeros((len(some), longest), int)
        for i, s in enumerate(some):
            o[i, : len(s)] = s
        alive = [int((size > t).sum()) for t in range(longest)]  # sequences are sorted: the first of them
        emitted = model.emission.T[o]  # sequence, time, tag
        forward, scale = np.zeros((longest, len(some), k)), np.ones((longest, len(some)))
        for t, n in enumerate(alive):
            now = (model.start if t == 0 else forward[t - 1, :n] @ model.transition) * emitted[:n, t]
            scale[t, :n] = now.sum(1)
            forward[t, :n] = now / scale[t, :n, None]
        like += float(np.log(scale).sum())
        backward = np.ones((len(some), k))
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            forward[t, :n] *= backward[:n]  # what a place holds of each tag
            if t == 0:
                start += forward[0, :n].sum(0)
                break
            after = emitted[:n, t] * backward[:n] / scale[t, :n, None]
            move += model.transition * (forward[t - 1, :n].T @ after)
            backward[:n] = after @ model.transition.T
        there = np.arange(longest)[:, None] < size
        held, at = forward[there], o.T[there]
        for tag in range(k):
            word[tag] += np.bincount(at, held[:, tag], word.shape[1])
    return like, start, move, word


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists of whole numbers as arrays; of a null one, an empty array."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(lists) else []


def symbol_ids(rows: DataFrame, frequent: list[str]) -> DataFrame:
    """rows(tokens) with symbols, the places of the tokens' symbols among symbols(frequent)."""
    names = F.array(*map(F.lit, symbols(frequent)))
    return rows.withColumn("symbols", F.transform("tokens", lambda t: (F.array_position(names, symbol(t, frequent)) - 1).cast("int")))


def reestimated(rows: DataFrame, model: Hmm) -> tuple[Hmm, float]:
    """One round over rows(symbols): the model that the expected counts make, and the log-likelihood of the one before."""
    sent = rows.sparkSession.sparkContext.broadcast((model.frequent, model.start, model.transition, model.emission, model.tags))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hmm(*sent.value)
        total: list = [0.0, np.zeros_like(own.start), np.zeros_like(own.transition), np.zeros_like(own.emission)]
        for batch in batches:
            for i, x in enumerate(expected(own, _arrays(batch.column(0)))):
                total[i] = total[i] + x
        for kind, x in enumerate(total):
            flat = np.atleast_1d(x).ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int64)), pa.array(flat[at])], names=["kind", "at", "v"])

    sums = rows.select("symbols").mapInArrow(count, "kind int, at long, v double").groupBy("kind", "at").agg(F.sum("v").alias("v")).collect()  # bounded by the model
    parts = [np.zeros(1), np.zeros_like(model.start), np.zeros_like(model.transition), np.zeros_like(model.emission)]
    for r in sums:
        parts[r.kind].ravel()[r["at"]] = r.v
    sent.unpersist()
    share = lambda x, old: np.divide(x, x.sum(-1, keepdims=True), out=old.copy(), where=x.sum(-1, keepdims=True) > 0)  # noqa: E731  a tag that never was stays as it is
    new = Hmm(model.frequent, share(parts[1], model.start), share(parts[2], model.transition), share(parts[3], model.emission), model.tags)
    return new, float(parts[0][0])


def fitted(rows: DataFrame, model: Hmm, rounds: int) -> tuple[Hmm, list[float]]:
    """The model after the rounds over rows(symbols), and the log-likelihoods before each."""
    said = []
    for _ in range(rounds):
        model, like = reestimated(rows, model)
        said.append(like)
    return model, said


def best_paths(scores: tuple[list[int], list[int], list[int]], k: int, seqs: list[np.ndarray]) -> list[np.ndarray]:
    """The best path of tags, as places, for each array of symbol ids, by the scores of a model of k tags."""
    start, move, word = (np.array(x, np.int64) for x in scores)
    rank = np.arange(k - 1, -1, -1)[:, None]  # beside a score, so that of equal ones the earlier tag is greater
    move, word = move.reshape(k, 1, k) * k, word.reshape(-1, k)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
    order = sorted((i for i, s in enumerate(seqs) if len(s)), key=lambda i: len(seqs[i]), reverse=True)
    for low in range(0, len(order), BATCH):
        some = [seqs[i] for i in order[low : low + BATCH]]
        size = np.array([len(s) for s in some])
        o = np.zeros((size[0], len(some)), np.int64)
        for i, s in enumerate(some):
            o[: len(s), i] = s
        alive = [int((size > t).sum()) for t in range(size[0])]  # sequences are sorted: the first of them
        back = np.zeros((size[0], len(some), k), np.int16)
        score = start + word[o[0]]
        for t, n in enumerate(alive[1:], 1):
            best = ((score[:n].T * k + rank)[:, :, None] + move).max(0)
            back[t, :n] = k - 1 - best % k
            score[:n] = best // k + word[o[t, :n]]
        path = np.zeros((size[0], len(some)), np.int64)
        last = score.argmax(1)  # a sequence's scores stay as they are once it has ended
        for t in range(size[0] - 1, -1, -1):
            n = alive[t]
            path[t, :n] = last[:n]
            last[:n] = back[t, np.arange(n), last[:n]]
        for i, at in enumerate(order[low : low + BATCH]):
            found[at] = path[: size[i], i]
    return found


def decoded(ids: Column, model: Hmm) -> Column:
    """array<string>: the best path of tags for an array of symbol ids; of none, none."""
    scores, tags = model.scores(), model.tags

    def decode(ids: pa.Array) -> pa.Array:
        paths = best_paths(scores, len(tags), _arrays(ids))
        ends = np.cumsum([0, *map(len, paths)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tags).take(pa.array(np.concatenate([np.zeros(0, np.int64), *paths]))))

    return F.arrow_udf(decode, "array<string>")(ids)


def tagged(docs: DataFrame, model: Hmm, key: str = "doc_id") -> DataFrame:
    """docs(key, text) to key, pos, token, tag: a row for each token."""
    return _each(_decoded(docs, model, key), key)


def _decoded(docs: DataFrame, model: Hmm, key: str) -> DataFrame:
    return symbol_ids(sequences(docs, key), model.frequent).select(key, "at", "tokens", decoded(F.col("symbols"), model).alias("tags"))


def _each(rows: DataFrame, key: str) -> DataFrame:
    each = F.explode(F.transform(F.arrays_zip("tokens", "tags"), lambda x, i: F.struct((F.col("at") + i).alias("pos"), x["tokens"].alias("token"), x["tags"].alias("tag"))))
    return rows.select(key, each.alias("e")).select(key, "e.pos", "e.token", "e.tag")


def tag_and_stem(docs: DataFrame, model: Hmm, lexicon, key: str = "doc_id") -> DataFrame:
    """docs(key, text) to key, pos, stem, tag, token, with stems of the words as their tags have them."""
    rows = _each(kept(_decoded(docs, model, key), "tagged"), key)
    table = stems(rows.select(F.col("token").alias("word"), "tag"), lexicon).select(F.col("word").alias("s_word"), F.col("tag").alias("s_tag"), "stem")
    return rows.join(table, (rows.token == F.col("s_word")) & (rows.tag == F.col("s_tag"))).select(key, "pos", "stem", "tag", "token")
