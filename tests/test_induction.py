from collections import Counter, defaultdict

import pytest

from verbaflow.functions.lexicon import DETACHMENTS, Lexicon
from verbaflow.operators import induction as i
from verbaflow.operators import stem

VERBS = ["walk", "talk", "jump", "climb", "paint", "help"]
DROPPED = ["bake", "love", "dance", "smile"]
NOUNS = ["table", "garden", "window", "river"]
WORDS = sorted(
    {w + e for w in VERBS for e in ("", "s", "ed", "ing")} | {w[:-1] + e for w in DROPPED for e in ("e", "es", "ed", "ing")} | {w + e for w in NOUNS for e in ("", "s")}
    | {"tall", "taller", "tallest", "small", "smaller", "smallest", "warm", "warmer", "warmest", "thing", "bring", "sing", "red", "bus", "gas", "axed"}
)


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("en", w) for w in WORDS] + [("xx", w) for w in ("walk", "walks")], "lang string, word string")


def plain(words, least_share, least_stems):
    """The same by hand, for one language."""
    cut = {(w[: len(w) - k], w[len(w) - k :]) for w in words for k in range(min(i.MOST_SUFFIX, len(w) - i.LEAST_STEM) + 1)}
    ends = Counter(e for _, e in cut)
    of = defaultdict(set)
    for s, e in cut:
        if not e or ends[e] >= len(words) * least_share:
            of[s].add(e or i.NONE)
    signature = {s: ".".join(sorted(e)) for s, e in of.items() if len(e) > 1}
    n = Counter(signature.values())
    good = {s for s, x in signature.items() if n[x] >= least_stems}
    forms = defaultdict(set)
    for w in words:
        for pos, old, new in DETACHMENTS:
            s = w[: len(w) - len(old)]
            if w.endswith(old) and s in good and s + new in words:
                forms[s + new, pos].add(old)
    return signature, {(f, p, len(e)) for (f, p), e in forms.items() if len(e) >= i.LEAST_FORMS[p]}


def test_against_plain_version(words):
    signature, lemmas = plain(set(WORDS), 0.02, 3)
    found = {r.stem: r.signature for r in i.signatures(words.where("lang = 'en'"), 0.02).collect()}
    assert found == signature
    got = {(r.form, r.pos, r.n_forms) for r in i.induced(words, 0.02).where("lang = 'en'").collect()}
    assert got == lemmas
    assert {(w, "v") for w in VERBS + DROPPED} <= {(f, p) for f, p, _ in got}
    assert {(w, "n") for w in NOUNS} <= {(f, p) for f, p, _ in got}
    assert ("tall", "a") in {(f, p) for f, p, _ in got}
    assert not {"th", "br", "r", "bu", "ga"} & {f for f, _, _ in got}
    assert i.induced(words, 0.02).where("lang = 'xx'").count() == 0  # one stem makes no signature productive


def test_stems_by_an_induced_lexicon(spark, words):
    """Every inflection of the regular words finds its lemma; the seed alone knows few."""
    pairs = {w + e: w for w in VERBS for e in ("s", "ed", "ing")} | {w[:-1] + e: w for w in DROPPED for e in ("es", "ed", "ing")} | {w + "s": w for w in NOUNS}
    rows = spark.createDataFrame([(w, None) for w in [*pairs, "bring", "red", "bus"]], "word string, tag string")
    seed = Lexicon.seed(spark)
    found = {r.word: r.stem for r in stem.stems(rows, i.lexicon(i.induced(words, 0.02).where("lang = 'en'"), seed)).collect()}
    assert {w: found[w] for w in pairs} == pairs
    assert (found["bring"], found["red"], found["bus"]) == ("bring", "red", "bus")
    before = {r.word: r.stem for r in stem.stems(rows, seed).collect()}
    assert sum(before[w] == v for w, v in pairs.items()) < len(pairs) / 3


def test_odd_words(spark):
    tokens = spark.createDataFrame([("en", "Ab"), ("en", "walks"), ("en", "WALKS"), ("en", "x1"), ("en", ""), ("en", None), (None, "walks")], "lang string, token string")
    assert {(r.lang, r.word) for r in i.word_types(tokens).collect()} == {("en", "ab"), ("en", "walks"), (None, "walks")}
    assert i.induced(i.word_types(tokens)).count() == 0
