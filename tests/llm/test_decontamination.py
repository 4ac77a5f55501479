import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from verbaflow.llm import decontamination as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(text, items, window=10):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        size = min(window, len(v))
        for a in range(len(v) - size + 1 if v else 0):
            for b in range(len(w) - size + 1):
                if w[b : b + size] == v[a : a + size]:
                    hit.update(range(b, b + size))
                    ids.add(i)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


def case(seed):
    rnd = random.Random(seed)
    v = ["ab", "C", "déjà", "x1", "the"]
    text = lambda n: "".join(rnd.choice(v) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(8)]
    docs = [text(rnd.randrange(0, 40)) + rnd.choice(items)[1].upper() + text(5) for _ in range(40)]
    return items, docs


def frames(spark, items, docs):
    return (
        spark.createDataFrame([(i, x, "q") for i, x in enumerate(docs)], "doc_id long, text string, n_words string"),
        spark.createDataFrame([(i, x, "q") for i, x in items], "item_id long, text string, doc_id string"),
    )


@pytest.mark.parametrize(("seed", "block"), [(1, 10**6), (2, 10**6), (3, 12), (4, 12)])
def test_against_brute_force(spark, seed, block):
    items, docs = case(seed)
    docs += [None, "", " .,", "ÀB ab"]
    items += [(100, None), (101, ""), (102, items[3][1]), (3, items[3][1])]
    out = {r.doc_id: tuple(r)[1:] for r in d.contamination(*frames(spark, items, docs), block_words=block).collect()}
    assert out == {i: plain(x, items) for i, x in enumerate(docs)}


def test_empty(spark):
    docs, items = frames(spark, [], ["a b"])
    assert [r.contaminated for r in d.contamination(docs, items).collect()] == [False]
    assert d.contamination(docs.limit(0), items).collect() == []


def test_items_without_an_id(spark):
    a, b = "one two three four five six seven eight nine ten", "red green blue"
    docs, items = frames(spark, [(None, a), (None, b), (1, b)], [f"x {a} y", f"x {b} {a}", "one two"])
    out = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.contamination(docs, items).collect()}
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    assert out == {0: (10, 1, sha(""), True), 1: (13, 2, sha("1"), True), 2: (0, 0, sha(""), False)}
    assert {r.doc_id for r in d.decontaminated(docs, items).collect()} == {2}


def test_cutting(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs, items = frames(spark, [(1, passage)], [f"Before, {passage.upper()}! After that much more text stands here. And more of it.", passage + " x", "clean é text", None, ""])
    docs = docs.withColumn("n_chars", F.length("text"))
    out = {r.doc_id: r for r in d.decontaminated(docs, items).collect()}
    assert out[0].text == "Before, ! After that much more text stands here. And more of it." and out[0].n_chars == len(out[0].text)
    assert 1 not in out and (out[2].text, out[3].text, out[4].text) == ("clean é text", None, "")


def test_a_cut_that_makes_a_new_passage(spark):
    one, two = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10", "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10"
    docs, items = frames(spark, [(1, one), (2, two)], [f"w1 w2 w3 w4 w5 w6 w7 w8 {two[:14]} {one} {two[15:]} w9"])
    (row,) = d.decontaminated(docs, items).collect()
    assert row.text.split() == [f"w{i}" for i in range(1, 10)]


@pytest.mark.parametrize("block", [10**6, 12])
def test_long_texts_null_ids_and_repeated_rows(spark, monkeypatch, block):
    monkeypatch.setattr(d, "PIECE", 64)
    items, docs = case(9)
    long = " ".join(docs * 3)
    rows = [(None, long, "q"), (None, long, "q"), (2, "x" * 500 + " " + items[2][1], "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    bench = frames(spark, items, [])[1]
    out = [tuple(r) for r in d.contamination(df, bench, block_words=block).collect()]
    assert sorted(out, key=str) == sorted([(i, *plain(t, items)) for i, t, _ in rows], key=str)
    kept = d.decontaminated(df, bench, coverage=2, block_words=block)
    assert kept.columns == df.columns and kept.count() == 3
    assert not any(r.contaminated for r in d.contamination(kept, bench).collect())


def test_automaton_holds_all_substrings():
    rnd = random.Random(7)
    items = [(i, [bytes([rnd.choice(b"ab")]) for _ in range(30)]) for i in range(4)]
    a = d.Automaton(items, 3)
    for _, w in items:
        for i in range(30):
            state = 0
            for x in w[i:]:
                state = a.next[state][x]
            assert state
    assert len(a.next) < 2 * 120


def test_several_blocks_cut_as_one_does(spark):
    items, docs = case(5)
    docs += [None, "", "w1 w2 w3 " + items[2][1], *docs[:3]]
    df, bench = frames(spark, items, docs)
    df = df.withColumnRenamed("n_words", "__key").withColumns({"__new": F.lit("n"), "n_chars": F.length("text")})
    one, many = (d.decontaminated(df, bench, block_words=n) for n in (10**6, 12))
    assert one.columns == many.columns == df.columns
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    assert d.decontaminated(df.limit(0), bench, block_words=12).collect() == []


def test_blocks_are_bounded_and_keep_every_window(spark):
    """An item that is longer than a block is cut so that no window is lost; where it is cut, windows are found too."""
    words = [f"w{i}" for i in range(900)] + ["x" * 3000] + [f"v{i}" for i in range(200)]
    docs, bench = frames(spark, [(1, " ".join(words)), (2, "a b c"), (3, None)], [" ".join(words[i : i + 10]) for i in range(0, len(words) - 9, 7)] + ["q a b c", "w1 w2 w3"])
    blocks = d.Blocks(spark, bench, 10, 200)
    assert 1 < blocks.n and blocks._heaviest() <= 250
    out = sorted((r.doc_id, r.n_hit, r.n_items) for r in d.contamination(docs, bench, block_words=200).collect())
    n = len(out) - 2
    assert out == [(i, 10, 1) for i in range(n)] + [(n, 3, 1), (n + 1, 0, 0)]
