"""The language of a text, by a character model that known texts make: each language's share of character trigrams, smoothed,
and the language under which a text's trigrams are likeliest. Scores are whole thousandths of logarithms, so that sums
are exact and the same everywhere.

Trigrams are whole numbers of three code points, in arrays of many texts. A task counts the ones it meets before they are
shuffled, and the model, whose size the number of trigrams bounds, is sent to all tasks, which add up a text's trigrams where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hmm import kept

SIZE = 3
#: Trigrams of a model, the most frequent ones; of languages, at most.
MOST_GRAMS, MOST_LANGUAGES = 100_000, 200


#: Characters that are worked on at once, and trigrams that a task holds before it hands their counts on.
AT_ONCE, HELD = 1 << 20, 1 << 18


def plain(text: Column) -> Column:
    """The text in lower case, whose letters stand alone and other characters as one space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of plain texts, and the place of each one's text. No plain text holds the character that parts them here."""
    c = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    ids = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    whole = (c[:-2] != 0) & (c[1:-1] != 0) & (c[2:] != 0)
    return ids[whole], np.cumsum(c == 0)[:-2][whole]


def _ids(grams: list[str]) -> np.ndarray:
    c = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, SIZE)
    return (c[:, 0] << 42) | (c[:, 1] << 21) | c[:, 2]


def _spelt(ids: np.ndarray) -> list[str]:
    all_ = np.stack([ids >> 42, (ids >> 21) & 0x1FFFFF, ids & 0x1FFFFF], 1).astype(np.uint32).tobytes().decode("utf-32-le")
    return [all_[i : i + SIZE] for i in range(0, len(all_), SIZE)]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of AT_ONCE characters in all; a longer text is one of its own."""
    low, size = 0, 0
    for i, n in enumerate(sizes):
        if i > low and size + n > AT_ONCE:
            yield low, i
            low, size = i, 0
        size += n
    if low < len(sizes):
        yield low, len(sizes)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.zeros(len(ids), np.int64)
    np.add.at(counts, where, np.concatenate([p[1] for p in parts]))
    return ids, counts


def counted(docs: DataFrame) -> DataFrame:
    """docs(lang, text) to lang, gram, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (ids, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(_spelt(ids), pa.string()), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            for low, high in _slices(list(map(len, texts))):
                for lang in dict.fromkeys(langs[low:high]):
                    ids, n = np.unique(_grams([t for t, x in zip(texts[low:high], langs[low:high], strict=True) if x == lang])[0], return_counts=True)
                    held[lang] = _merged([held[lang], (ids, n)]) if lang in held else (ids, n)
                if sum(len(ids) for ids, _ in held.values()) > HELD:
                    yield from told()
        yield from told()

    some = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", plain(F.col("text")).alias("text"))
    return some.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """table(gram, gains): what a trigram adds to each language's score beyond that of an unseen one; unseen: the latter."""

    languages: list[str]
    unseen: list[int]
    table: DataFrame


def trained(docs: DataFrame, most: int = MOST_GRAMS) -> Model:
    """From docs(lang, text) with known languages; rows without one are left out. Of equally frequent trigrams at the end of
    the model the first by code points stays."""
    counts = counted(docs)
    languages = sorted(r.lang for r in docs.where("lang IS NOT NULL").select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    own = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
    table = kept(counts.groupBy("gram").agg(F.sum("n").alias("n"), *own).orderBy(F.col("n").desc(), "gram").limit(most), "trigrams")
    total = table.agg(F.count(F.lit(1)).alias("size"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages)))).first()
    below = [(total[f"n{i}"] or 0) + total["size"] for i in range(len(languages))]
    score = lambda n, i: F.floor(1000 * F.log((n + 1) / F.lit(max(below[i], 1)).cast("double")) + 0.5).cast("int")
    unseen = list(table.sparkSession.range(1).select(*(score(F.lit(0), i) for i in range(len(languages)))).first()) if languages else []
    gains = F.array(*(score(F.col(f"n{i}"), i) - unseen[i] for i in range(len(languages)))) if languages else F.array().cast("array<int>")
    return Model(languages, unseen, table.select("gram", gains.alias("gains")))


def identified(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """docs(*keep, text) to *keep, n_grams, guessed, score: the likeliest language, the first by name of equal ones, and its score.
    Texts without letters, and null ones, have neither. Repeated rows are kept."""
    rows = model.table.toArrow()  # at most MOST_GRAMS
    ids = _ids(rows["gram"].to_pylist())
    order, k = np.argsort(ids), len(model.languages)
    gains = np.array(rows["gains"].to_pylist(), np.int64).reshape(-1, k)[order].T if k else np.zeros((0, 0), np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((ids[order], gains, model.unseen))

    def judge(plain: pa.Array) -> pa.Array:
        known, gains, unseen = sent.value
        texts = [t or "" for t in plain.to_pylist()]
        n_grams, at, score = (np.zeros(len(texts), np.int64) for _ in range(3))
        for low, high in _slices(list(map(len, texts))):
            found, row = _grams(texts[low:high])
            n_grams[low:high] = n = np.bincount(row, minlength=high - low)
            if not len(unseen):
                continue
            place = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
            hit = known[place] == found if len(known) else np.zeros(len(found), bool)
            place, row = place[hit], row[hit]
            # sums of whole numbers far below 2^53
            sums = np.array([np.bincount(row, g[place], high - low).astype(np.int64) + n * u for g, u in zip(gains, unseen, strict=True)])
            at[low:high], score[low:high] = sums.argmax(0), sums.max(0)
        none = (n_grams == 0) | (not len(unseen))
        return pa.StructArray.from_arrays([pa.array(n_grams), pa.array(at.astype(np.int32), mask=none), pa.array(score, mask=none)], names=["n_grams", "at", "score"])

    told = F.arrow_udf(judge, "struct<n_grams: long, at: int, score: long>")(plain(F.col("text")))
    named = F.get(F.array(*map(F.lit, model.languages)), F.col("__told.at")) if k else F.lit(None).cast("string")
    return docs.select(*keep, told.alias("__told")).select(*keep, "__told.n_grams", named.alias("guessed"), "__told.score")
