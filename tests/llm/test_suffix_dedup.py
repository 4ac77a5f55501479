import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbaflow.llm import suffix_dedup as s


def plain(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, least):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("key", "__key", "n_bytes", "own", "start")})
    out = s.removals(df, least)
    assert set(out.columns) == {"doc_id", "key", "__key", "own", "start", "n_bytes", "n_removed", "n_spans", "kept_sha256"}
    return sorted(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def made(seed, n, longest, letters="ab c"):
    """Texts that share passages, with edits, copies, and runs of one letter."""
    r = random.Random(seed)
    passage = ["".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [r.choice(passage) if r.random() < 0.5 else "".join(r.choice(letters + "défgh") for _ in range(r.randint(0, longest))) for _ in range(r.randint(0, 4))]
        text = "".join(parts)
        if text and r.random() < 0.4:
            at = r.randrange(len(text))
            text = text[:at] + "Z" + text[at + 1 :]
        texts.append(text)
    texts += [texts[0]] * 3 + [texts[1], "a" * longest, "a" * (longest - 1), "ab" * longest, "", None]
    return [(i if i % 7 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "least"), [(1, 8), (2, 9), (3, 25), (4, 40)])
def test_against_brute_force(spark, seed, least):
    rows = made(seed, 60, 4 * least)
    assert found(spark, rows, least) == plain(rows, least)


def test_long_texts_in_pieces_and_hot_passages(spark, monkeypatch):
    """Texts longer than a piece, and a passage that a third of the texts hold amid different words."""
    monkeypatch.setattr(s, "PIECE", 300)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    hot = " ".join(word() for _ in range(20))
    rows = [(i, " ".join([*(word() for _ in range(r.randint(5, 200))), *([hot] if i % 3 == 0 else []), *(word() for _ in range(5))])) for i in range(60)]
    rows += [(100, "-" * 1500), (101, rows[7][1][:700] + "!" + rows[7][1][700:]), (102, "xyz" * 400)]
    assert found(spark, rows, 50) == plain(rows, 50)


def test_threshold_itself(spark):
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    a, b, c = text(200), text(199), text(150)
    rows = [(1, "<" + a + ">" + text(300)), (2, text(300) + "[" + a + "]"), (3, b + "!"), (4, b + "?"), (5, c), (6, c), (7, a[1:] + "/" + text(9)), (8, "ü" * 99 + "."), (9, "ü" * 99 + ";")]
    got = found(spark, rows, 200)
    assert got == plain(rows, 200)
    assert [(x[0], x[2]) for x in got if x[2]] == [(1, 200), (2, 200)]


def test_empty_tables(spark):
    assert found(spark, [], 200) == []
    assert found(spark, [(1, None), (2, ""), (None, "short")], 200) == plain([(1, None), (2, ""), (None, "short")], 200)


def test_names_and_least_of_windows():
    r = np.random.default_rng(1)
    b = r.integers(0, 3, 400).astype(np.uint8)
    for length in (1, 2, 7, 20, 100):
        h = s.hashes(b, length)
        assert len(h) == len(b) - length + 1
        of = {}
        for i, x in enumerate(h.tolist()):
            of.setdefault(bytes(b[i : i + length]), set()).add(x)
        assert all(len(x) == 1 for x in of.values()) and len({x for y in of.values() for x in y}) == len(of)
    h = r.integers(0, 9, 300).astype(np.uint64)
    for width in (1, 2, 5, 37):
        assert s.first_least(h, width).tolist() == [i + int(h[i : i + width].argmin()) for i in range(300 - width + 1)]


def test_parts_end_at_single_starts():
    level, rounds = [(0, 100)], 0
    while level:
        level = [p for a, b in level for p in s.parts_of(a, b) if p[0] < p[1]]
        rounds += 1
    assert rounds == 4 and [p for a, b in s.parts_of(0, 100) for p in range(a, b + 1)] == list(range(101))
