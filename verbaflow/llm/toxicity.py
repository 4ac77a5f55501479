"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are words and beginnings of words that mark labelled toxic texts. The model knows ordered severity grades:
P(grade <= k) = logistic(threshold_k - w.x), one weight vector w for all thresholds. Its output is the expected
severity. Labels say only toxic or not. Grade 0 is a text that isn't toxic; toxic ones are graded out of fold: a plain
regression on each half of the sample, with features of its own, weighs the toxic texts of the other half, and those
above the median weight are grade 2, the others grade 1.

Executors count the sample's words and features; the driver gets no texts, only the features that it chooses and the
sample's sparse vectors over those.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, discard, drawn, materialise, table, tidy, unused

#: Labelled documents that the model is fitted on, at most: those whose ids' hashes are least, so that both labels have the
#: shares that they have among all. Copies of a text count once.
SAMPLE = 16_000
#: A feature must occur in so many sampled texts, and toxic ones must be so large a share of them.
LEAST_TEXTS, LEAST_SHARE, MOST_FEATURES = 5, 0.6, 4_096
HEADS = (4, 5, 6, 7, 8, 9)
STEPS, RATE, RIDGE = 400, 0.1, 0.001
#: Expected severity from which a text is rejected.
REJECT = 0.4
#: Words whose features a worker remembers before it starts afresh.
REMEMBERED = 200_000
WORD = re.compile(r"[^\W\d_]+")


def parts_of(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in HEADS if len(word) >= n)]


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, texts: list[str | None], memory: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Expected grade of each text; memory holds words' features and may be shared between calls."""
        eta = np.zeros(len(texts))
        for i, text in enumerate(texts):
            sums = _sums(bag_of(text), self.features, memory)
            eta[i] = sum(self.weights[k] * np.log1p(n) for k, n in sums.items())
        return _above(eta, self.thresholds).sum(1)


def bag_of(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def _sums(bag: dict[str, int], features: dict[str, int], memory: dict[str, tuple[int, ...]]) -> dict[int, int]:
    """How often a bag of words has each feature that it has."""
    out: dict[int, int] = {}
    for word, n in bag.items():
        ids = memory.get(word)
        if ids is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            ids = memory[word] = tuple(features[p] for p in parts_of(word) if p in features)
        for k in ids:
            out[k] = out.get(k, 0) + n
    return out


def _above(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each text and threshold."""
    return 1 / (1 + np.exp(-np.clip(eta[:, None] - thresholds[None, :], -30, 30)))


@dataclass
class Vectors:
    """Sparse rows: row, column and value of each entry; the rows' labels and folds."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    toxic: np.ndarray
    fold: np.ndarray

    def of(self, columns: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries in some columns and rows, each renumbered in its order."""
        at_column, at_row = (np.full(int(x.max(initial=-1)) + 1, -1) for x in (np.append(self.column, columns), np.append(self.row, rows)))
        at_column[columns], at_row[rows] = np.arange(len(columns)), np.arange(len(rows))
        keep = (at_column[self.column] >= 0) & (at_row[self.row] >= 0)
        return at_row[self.row[keep]], at_column[self.column[keep]], self.value[keep]


def fit(x: Vectors, features: list[list[str]]) -> Model:
    """features: of each fold, and of all. Without toxic or without clean texts nothing marks toxicity, and every text's
    severity is near 0."""
    names = {f: k for k, f in enumerate(dict.fromkeys(f for some in features for f in some))}
    columns = [np.array([names[f] for f in some], int) for some in features]
    weight = np.full(len(x.toxic), -np.inf)
    for fold in (0, 1):
        mine, others = (np.flatnonzero((x.fold == fold) == own) for own in (True, False))
        w, _ = _regress(*x.of(columns[fold], mine), x.toxic[mine], len(columns[fold]), 1)
        r, c, v = x.of(columns[fold], others)
        weight[others] = np.bincount(r, v * w[c], len(others))
    middle = np.median(weight[x.toxic == 1]) if x.toxic.any() else 0.0
    grade = np.where(x.toxic == 1, np.where(weight > middle, 2, 1), 0)
    w, thresholds = _regress(*x.of(columns[2], np.arange(len(grade))), grade, len(columns[2]), 2)
    return Model({f: k for k, f in enumerate(features[2])}, w, thresholds)


def likelihood(eta: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The probability of each text's own grade."""
    n = len(grade)
    over = np.concatenate([np.ones((n, 1)), _above(eta, thresholds), np.zeros((n, 1))], 1)
    return np.maximum(over[np.arange(n), grade] - over[np.arange(n), grade + 1], 1e-9)


def _regress(r: np.ndarray, c: np.ndarray, v: np.ndarray, grade: np.ndarray, m: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch adaptive gradient steps on the penalised likelihood of grades 0 to levels; the
    thresholds are a first one and the logarithms of positive gaps."""
    n = len(grade)
    if not n or not m:
        return np.zeros(m), 10.0 + 2 * np.arange(levels)
    w, cut = np.zeros(m), np.concatenate([[1.0], np.zeros(levels - 1)])
    mean, square = np.zeros(m + levels), np.zeros(m + levels)
    at = np.arange(n)
    for step in range(1, STEPS + 1):
        eta, t = np.bincount(r, v * w[c], n), _thresholds(cut)
        over = np.concatenate([np.ones((n, 1)), _above(eta, t), np.zeros((n, 1))], 1)
        p = likelihood(eta, grade, t)
        slope = over * (1 - over)
        d_eta = (slope[at, grade] - slope[at, grade + 1]) / p
        d_t = np.array([(np.where(grade == k + 1, -1.0, np.where(grade == k, 1.0, 0.0)) * slope[:, k + 1] / p).mean() for k in range(levels)])
        d_cut = np.cumsum(d_t[::-1])[::-1] * np.concatenate([[1.0], np.exp(cut[1:])])
        g = np.concatenate([np.bincount(c, v * d_eta[r], m) / n - RIDGE * w / np.sqrt(n), d_cut])
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, cut = w + move[:m], cut + move[m:]
    return w, _thresholds(cut)


def _thresholds(cut: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, toxic, text) to at, toxic and the text's words with their counts."""
    for batch in batches:
        for some in by_bytes(batch, 2):
            bags = [bag_of(t) for t in some.column(2).to_pylist()]
            cols = [pa.array([list(b) for b in bags], pa.list_(pa.string())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *cols], names=["at", "toxic", "words", "n"])


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, toxic, words) to how many texts of each fold, toxic and not, have a feature."""
    for batch in batches:
        for low in range(0, batch.num_rows, 50):
            some = batch.slice(low, 50)
            counts: Counter = Counter()
            for fold, toxic, words in zip(*(c.to_pylist() for c in some.columns), strict=True):
                counts.update((p, fold, toxic) for p in {p for w in words for p in parts_of(w)})
            rows = list(counts)
            cols = [[k[0] for k in rows], [k[1] for k in rows], [n * k[2] for k, n in counts.items()], list(counts.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["feature", "fold", "toxic", "n"])


def _marking(counts: DataFrame, toxic: int, texts: int) -> list[str]:
    """The features (feature, toxic, n) that mark toxic texts best, of `texts` texts of which `toxic` are: MOST_FEATURES at most."""
    if not 0 < toxic < texts:
        return []
    good = counts.where((F.col("n") >= LEAST_TEXTS) & (F.col("toxic") >= LEAST_SHARE * F.col("n")))
    score = F.col("toxic") * F.log(F.col("toxic") / F.col("n") / F.lit(toxic / texts))
    return [r.feature for r in good.orderBy(score.desc(), F.col("feature").desc()).limit(MOST_FEATURES).collect()]


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Of several labels of one id the greatest counts, of several texts of one id the one of least hash, equal texts once;
    labels without a text, and null ones, are left out. So at most `sample` texts are fitted on, whatever repeats."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    ids = F.broadcast(drawn(known, "doc_id", sample))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(ids, "doc_id").select("doc_id", F.xxhash64("text").alias("at"), F.col("__toxic").alias("toxic"), "text")
    least = rows.groupBy("doc_id").agg(F.min("at").alias("at"))  # at most `sample` rows
    rows = rows.join(F.broadcast(least), ["doc_id", "at"], "left_semi").select("at", "toxic", "text")
    bags = rows.mapInArrow(tidy(_bags), "at long, toxic int, words array<string>, n array<int>")
    once = bags.groupBy("at").agg(F.max(F.struct("toxic", "words", "n")).alias("x"))
    some = materialise(once.select("at", F.pmod("at", F.lit(2)).cast("int").alias("fold"), "x.*"), "toxicity-sample")
    shown = some.select("fold", "toxic", "words").mapInArrow(tidy(_shown), "feature string, fold int, toxic long, n long")
    counts = materialise(shown.groupBy("feature", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")), "toxicity-features")
    sizes = {r.fold: (r.toxic, r.n) for r in some.groupBy("fold").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()}
    features = [_marking(counts.where(F.col("fold") == k), *sizes.get(k, (0, 0))) for k in (0, 1)]
    every = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    features.append(_marking(every, *(sum(s[i] for s in sizes.values()) for i in (0, 1))))
    names = {f: k for k, f in enumerate(dict.fromkeys(f for chosen in features for f in chosen))}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            sums = [_sums(dict(zip(w, n, strict=True)), names, memory) for w, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            cols = [pa.array([list(s) for s in sums], pa.list_(pa.int32())), pa.array([list(s.values()) for s in sums], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["at", "fold", "toxic", "column", "n"])

    # at most `sample` rows of at most 3 * MOST_FEATURES entries
    found = some.mapInArrow(tidy(vectors), "at long, fold int, toxic int, column array<int>, n array<int>").toArrow().sort_by("at")
    discard(some, counts)
    size = [len(c) for c in found["column"].to_pylist()]
    flat = lambda name: np.array([x for one in found[name].to_pylist() for x in one], int)
    return fit(Vectors(np.repeat(np.arange(len(size)), size), flat("column"), np.log1p(flat("n").astype(float)), found["toxic"].to_numpy().astype(int), found["fold"].to_numpy().astype(int)), features)


def graded(docs: DataFrame, model: Model, into: str = "__severity") -> DataFrame:
    """docs with a further column, called `into`: the expected grade, 0 to 2.

    A null or empty text has no features; a long one is graded whole. Repeated rows and null ids are kept, an empty table
    gives no rows, and all other columns pass through as they are.
    """
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for some in by_bytes(batch, at):
                severity = model.severity(some.column(at).to_pylist(), memory)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(severity, pa.float64())], names=[*some.schema.names, into])

    return docs.mapInArrow(tidy(grade), schema)


def judged(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """docs(doc_id, text) to doc_id, severity, rejected: whether the severity is `reject` or more.

    Null and empty texts have the severity of a text without features. Repeated rows and null ids are kept, an empty
    table gives no rows, other columns are ignored.
    """
    rows = graded(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.col("__severity").alias("severity"), (F.col("__severity") >= reject).alias("rejected"))


def accepted(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of docs that aren't rejected, with the columns of docs, whatever those are called."""
    into = unused(docs, "__severity")
    return graded(docs, model, into).where(F.col(into) < reject).drop(into)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, trained(docs, table(spark, sf_dir, "labels")))
