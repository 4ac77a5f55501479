"""A lexicon induced from the words of a corpus, by suffix signatures after Goldsmith, "Unsupervised Learning of the
Morphology of a Natural Language" (2001).

Every word is cut into stem and suffix in all ways. The suffixes that a stem is found with are its signature; a signature that
several stems share is productive: so many stems don't take the same endings by chance. A word is taken for a lemma if
detachment rules lead to it from words of the corpus, along productive signatures, in as many ways as its part of speech asks for.
All of it is counting and joining of distinct words; nothing has to fit anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DETACHMENTS, Lexicon
from .hmm import kept

#: Letters of a stem, at least; of a suffix, at most.
LEAST_STEM, MOST_SUFFIX = 3, 5
#: A suffix is looked at if this share of a language's words, or more, end in it.
LEAST_SHARE = 0.001
#: Stems that share a productive signature, at least.
LEAST_STEMS = 3
#: Endings of one part of speech that a lemma must be found with. The plural is the only one that nouns have.
LEAST_FORMS = {"n": 1, "v": 2, "a": 2}
#: How the suffix of no letters is written in signatures.
NONE = "0"


def word_types(tokens: DataFrame) -> DataFrame:
    """tokens(lang, token) to its distinct (lang, word): in lower case, of letters only."""
    return tokens.select("lang", F.lower("token").alias("word")).where(F.col("word").rlike(r"^\p{L}+$")).distinct()


def splits(words: DataFrame) -> DataFrame:
    """words(lang, word) to lang, stem, suffix."""
    most = F.least(F.lit(MOST_SUFFIX), F.length("word") - LEAST_STEM)
    cut = F.explode(F.when(most >= 0, F.sequence(F.lit(0), most)))
    rows = words.select("lang", "word", cut.alias("k"))
    return rows.select("lang", F.left("word", F.length("word") - F.col("k")).alias("stem"), F.right("word", F.col("k")).alias("suffix"))


def signatures(words: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """words(lang, word) to lang, stem, signature: the stem's suffixes in order, two or more."""
    cut = splits(words)
    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    common = cut.where("suffix <> ''").groupBy("lang", "suffix").agg(F.count(F.lit(1)).alias("n"))
    common = common.join(F.broadcast(sizes), "lang").where(F.col("n") >= F.col("size") * least_share).select("lang", "suffix")  # at most MOST_SUFFIX / least_share for each language
    rows = cut.where("suffix <> ''").join(F.broadcast(common), ["lang", "suffix"], "left_semi").unionByName(cut.where("suffix = ''"))
    each = rows.groupBy("lang", "stem").agg(F.sort_array(F.collect_set(F.when(F.col("suffix") == "", NONE).otherwise(F.col("suffix")))).alias("s"))
    return each.where(F.size("s") > 1).select("lang", "stem", F.array_join("s", ".").alias("signature"))


def productive(found: DataFrame, least: int = LEAST_STEMS) -> DataFrame:
    """signatures() to lang, signature, n_stems, for those of `least` stems or more."""
    return found.groupBy("lang", "signature").agg(F.count(F.lit(1)).alias("n_stems")).where(F.col("n_stems") >= least)


def _detached(word: Column) -> Column:
    """array<struct<pos, stem, form, ending>>: what the rules make of a word, and the stem before the ending."""
    made = [
        F.when(word.endswith(old), F.struct(F.lit(pos).alias("pos"), F.left(word, F.length(word) - len(old)).alias("stem"), F.concat(F.left(word, F.length(word) - len(old)), F.lit(new)).alias("form"), F.lit(old).alias("ending")))
        for pos, old, new in DETACHMENTS
    ]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def induced(words: DataFrame, least_share: float = LEAST_SHARE, least_stems: int = LEAST_STEMS) -> DataFrame:
    """words(lang, word) to lang, form, pos, n_forms: words of the corpus that are lemmas, and with how many endings they were found.
    Words are read several times: where they are made from texts, keep them first."""
    found = kept(signatures(words, least_share), "signatures")
    good = found.join(productive(found, least_stems), ["lang", "signature"], "left_semi").select("lang", "stem")
    ways = words.select("lang", F.explode(_detached(F.col("word"))).alias("d")).select("lang", "d.*")
    rows = ways.join(good, ["lang", "stem"], "left_semi").join(words.withColumnRenamed("word", "form"), ["lang", "form"], "left_semi")
    lemmas = rows.groupBy("lang", "form", "pos").agg(F.countDistinct("ending").alias("n_forms"))
    least = F.create_map(*(F.lit(x) for kv in LEAST_FORMS.items() for x in kv))
    return lemmas.where(F.col("n_forms") >= F.element_at(least, F.col("pos")))


def lexicon(lemmas: DataFrame, base: Lexicon) -> Lexicon:
    """base with lemmas(form, pos) beside its own; its irregular forms stay."""
    return Lexicon(base.lemmas.select("form", "pos").unionByName(lemmas.select("form", "pos")).distinct(), base.exceptions)
