"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text's bytes, words and lines are binned at quantiles. Shallow trees are boosted in cycles, one feature
at a time, and each feature's trees add up to one lookup table; pairs of features then get two-way tables in the same
manner. A score is the sum of one bin's value from each table, through the logistic function: vectorised additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, drawn, table, tidy

#: Labelled rows that the model is fitted on, at most: those whose ids' hashes are least.
SAMPLE = 20_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_ROUNDS, PAIR_BINS, RIDGE = 48, 120, 0.15, 3, 8, 40, 8, 4.0
THRESHOLD = 0.7
FEATURES = [
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "stop_mark", "odd_mark", "beyond_ascii",
    "distinct_words", "top_word", "log_lines", "mean_line", "distinct_lines", "line_end_mark", "longest_word", "all_caps", "marked_words", "repeated_pairs",
]

_CLASS = np.zeros(256, np.int8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'-"]] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-"]] = 5
_CLASS[128:] = 6


def features_of(text: bytes | None) -> list[float]:
    """The FEATURES of one whole text; null is as empty."""
    text = text or b""
    n = len(text)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7) if n else np.zeros(7)
    words = text.split()
    m = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = len(lines)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    caps = marked = 0
    for w, c in seen.items():
        if len(w) > 1 and w.isupper():
            caps += c
        if w[-1] in b"!#$%&*|+=@~^":
            marked += c
    share = kinds / max(n, 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(n), np.log1p(m), n / max(m, 1), share[1], share[2], share[3], share[4], share[5], share[6],
        len(seen) / max(m, 1), max(seen.values(), default=0) / max(m, 1), np.log1p(k), np.log1p(n / max(k, 1)), len(set(lines)) / max(k, 1),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(k, 1), np.log1p(max(map(len, seen), default=0)), caps / max(m, 1), marked / max(m, 1),
        1 - pairs / max(m - 1, 1) if m > 1 else 0.0,
    ]


@dataclass
class Model:
    """cuts: ascending bin edges of each feature; tables: a value for each bin; pairs: (i, j, edges, edges, values)."""

    base: float
    cuts: list
    tables: list
    pairs: list

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += values[np.searchsorted(cuts, x[:, f], "right")]
        for i, j, a, b, values in self.pairs:
            z += values[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The values of a tree over ordered bins, grown best split first, from the bins' gradients and weights."""
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + RIDGE)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                won = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(np.argmax(won))
                best = max(best, (float(won[k]), (a, b), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One cut on either axis: the four corners' values, at the best pair of cuts."""
    gs, hs = (np.pad(np.cumsum(np.cumsum(m, 0), 1), ((1, 0), (1, 0))) for m in (g, h))
    n, m = g.shape
    best, out = -1.0, np.zeros_like(g)
    for a in range(1, n):
        for b in range(1, m):
            boxes = [(0, a, 0, b), (0, a, b, m), (a, n, 0, b), (a, n, b, m)]
            sums = [(s[q, t] - s[p, t] - s[q, r] + s[p, r]) for p, q, r, t in boxes for s in (gs, hs)]
            won = sum(x * x / (w + RIDGE) for x, w in zip(sums[::2], sums[1::2], strict=True))
            if won > best:
                best, out = won, np.zeros_like(g)
                for (p, q, r, t), x, w in zip(boxes, sums[::2], sums[1::2], strict=True):
                    out[p:q, r:t] = x / (w + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without rows, or with one label only, every text gets that label's share (0.5 without rows), smoothed."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if len(np.unique(y)) < 2:
        return Model(base, cuts, tables, [])
    binned = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(binned):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(tables[f])), np.bincount(b, h, len(tables[f])), LEAVES)
            tables[f] += step
            z += step[b]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    rough = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        n, m = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(rough[i] * m + rough[j], v, n * m).reshape(n, m)

    g, h = slopes()
    gains = sorted(((float((grid(i, j, g) ** 2 / (grid(i, j, h) + RIDGE)).sum()), i, j) for i in range(len(cuts)) for j in range(i)), reverse=True)
    pairs = [[i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))] for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for pair in pairs:
            g, h = slopes()
            step = RATE * _pair_tree(grid(pair[0], pair[1], g), grid(pair[0], pair[1], h))
            pair[4] += step
            z += step[rough[pair[0]], rough[pair[1]]]
    return Model(base, cuts, tables, [tuple(p) for p in pairs])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is none of the four."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """docs(*carry, text) to the carried columns and the array of features."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, len(carry)):
                rows = [features_of(t) for t in some.column(len(carry)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(carry)], pa.array(rows, pa.list_(pa.float64()))], names=[*carry, "x"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry]
    return docs.select(*carry, F.col("text").cast("binary").alias("text")).mapInArrow(tidy(measure), ", ".join([*kinds, "x array<double>"]))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted on at most `sample` labelled documents that aren't held out; of several labels of one id the greatest counts, of
    several texts of one id the one of least hash."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    some = drawn(usable.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", sample)
    texts = docs.join(F.broadcast(some), "doc_id").select("quality", "text", "doc_id", F.xxhash64("text").alias("at"))
    one = measured(texts, ["quality", "doc_id", "at"]).groupBy("doc_id").agg(F.min(F.struct("at", "x", "quality")).alias("one"))
    rows = one.orderBy("doc_id").select("one.quality", "one.x").toPandas()  # at most `sample`
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["quality"].to_numpy(float))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, score, predicted.

    Null and empty texts have the features of an empty text and are scored like any other. Repeated rows and null ids
    are kept, an empty table gives no rows, other columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, 2):
                x = np.array([features_of(t) for t in some.column(2).to_pylist()], float).reshape(some.num_rows, len(FEATURES))
                s = model.score(x)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(score), "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))
