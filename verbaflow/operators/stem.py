"""English stems: candidates from detachment rules, a semi-join to the lexicon, and the least bad of them.

Stems are found once for each distinct (word, part of speech), so the work follows the vocabulary, not the text. How the
stems meet the lexicon and the tokens is left to Spark, which broadcasts a side whose size it knows to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import AMBIGUOUS_EXCEPTIONS, DETACHMENTS, EXCEPTIONS, POS, STOPWORDS, Lexicon
from ..functions.text import topic_parts, untokenize
from ..functions.tokenize import tokenize

#: Words that a detachment rule applies to end so.
DETACHABLE = "(" + "|".join(sorted({old for _, old, _ in DETACHMENTS})) + ")$"


def word_badness(word: Column) -> Column:
    """What a good stem has little of: length, less so for the endings e, ess and ss."""
    return F.length(word) - F.when(word.endswith("e"), 2).when(word.endswith("ess"), 10).when(word.endswith("ss"), 4).otherwise(0)


def pos_of_tag(tag: Column) -> Column:
    """n, v, a or r for tags that begin with NN, VB, JJ or RB; any other as it is."""
    return F.when(tag.startswith("NN"), "n").when(tag.startswith("VB"), "v").when(tag.startswith("JJ"), "a").when(tag.startswith("RB"), "r").otherwise(tag)


def assumed_pos(word: Column, tag: Column) -> Column:
    """The letters to try, or null for all. Words in -ed are verbs whatever their tag, ones in -ing if they have none."""
    pos = pos_of_tag(tag)
    pos = F.when((pos.isNull() & word.endswith("ing")) | word.endswith("ed"), "v").otherwise(pos)
    return F.when(F.lit(POS).contains(pos), pos)


def _lookup(table: dict[str, str], word: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.try_element_at(pairs, word)


def override(word: Column, pos: Column) -> Column:
    """The fixed stem of a lower-case word, or null."""
    return F.coalesce(_lookup(EXCEPTIONS, word), F.when(pos.isNull(), _lookup(AMBIGUOUS_EXCEPTIONS, word)))


def _detached(form: Column, pos: Column) -> Column:
    """What the detachment rules of pos make of form, in their order."""
    out = F.array().cast("array<string>")
    for p in POS:
        made = [F.when(form.endswith(old), F.concat(F.left(form, F.length(form) - len(old)), F.lit(new))) for q, old, new in DETACHMENTS if p == q]
        if made:
            out = F.when(pos == p, F.filter(F.array(*made), lambda c: c.isNotNull())).otherwise(out)
    return out


def candidates(words: DataFrame) -> DataFrame:
    """words(word, pos) to word, pos, p, p_at, round, at, form: what may be a lemma of word as part of speech p.

    A round detaches endings from what the round before it made, until nothing is left to detach; no rule makes a form
    longer, and the one that makes it no shorter leaves nothing to detach, so rounds are as many as letters at most.
    """
    letters = F.filter(F.split(F.coalesce("pos", F.lit(POS)), ""), lambda c: c != "")
    rows = words.select("word", "pos", F.posexplode(letters).alias("p_at", "p"))

    def again(state: Column, step: Column) -> Column:
        forms = F.flatten(F.transform(F.element_at(state, -1), lambda f: _detached(f, F.col("p"))))
        return F.when((F.size(state) == step) & (F.size(forms) > 0), F.concat(state, F.array(forms))).otherwise(state)

    itself = F.array(F.array("word"))
    made = F.when(F.col("word").rlike(DETACHABLE), F.aggregate(F.sequence(F.lit(1), F.length("word")), itself, again)).otherwise(itself)
    rows = rows.select("word", "pos", "p", "p_at", F.posexplode(made).alias("round", "forms"))
    return rows.select("word", "pos", "p", "p_at", F.greatest(F.col("round"), F.lit(1)).alias("round"), ((F.col("round") > 0).cast("int")).alias("own"), F.posexplode("forms").alias("at", "form"))


def best_stems(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """words(word, pos) to word, pos, stem for those with a lemma: the least bad one, of equals the first found.

    For each part of speech an irregular form's lemmas stand in place of the rules; else the word itself and its first
    round of detachments count, and later rounds only while nothing was found.
    """
    odd = lexicon.exceptions.select(F.col("form").alias("word"), F.col("pos").alias("p"), F.col("lemma").alias("odd"))
    # the rules are work for the CPU: a given number of partitions isn't merged for being small in bytes
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = candidates(words.distinct().repartition(parts, "word")).join(odd, ["word", "p"], "left")
    one = F.struct("round", "own", "at", "form")
    itself = F.col("own") == 0
    irregular = F.struct(F.lit(1).alias("round"), F.lit(1).alias("own"), F.lit(0).alias("at"), F.col("odd").alias("form"))
    kept = F.when(F.col("odd").isNull(), F.array(one)).when(itself, F.array(one, irregular))
    pool = made.select("word", "pos", "p", "p_at", F.explode(kept).alias("c")).select("word", "pos", "p", "p_at", "c.*")
    known = pool.join(lexicon.lemmas.select("form", F.col("pos").alias("p")), ["form", "p"], "left_semi")
    badness = word_badness(F.col("form")).alias("badness")
    each = known.groupBy("word", "pos", "p").agg(F.min(F.struct("round", badness, "p_at", "own", "at", "form")).alias("best"))
    return each.groupBy("word", "pos").agg(F.min(F.struct("best.badness", "best.p_at", "best.own", "best.at", "best.form")).alias("best")).select("word", "pos", F.col("best.form").alias("stem"))


def stems(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """words(word, tag) to its distinct rows with their stem: a fixed one, else the best lemma, else the word in lower case."""
    rows = words.select("word", "tag").where("word IS NOT NULL").distinct().withColumn("low", F.lower("word"))
    rows = rows.withColumn("pos", assumed_pos(F.col("low"), F.col("tag"))).withColumn("fixed", override(F.col("low"), F.col("pos")))
    found = best_stems(rows.where("fixed IS NULL").select(F.col("low").alias("word"), "pos"), lexicon).select(F.col("word").alias("f_word"), F.col("pos").alias("f_pos"), "stem")
    out = rows.join(found, (rows.low == found.f_word) & rows.pos.eqNullSafe(found.f_pos), "left")
    return out.select("word", "tag", F.coalesce("fixed", "stem", "low").alias("stem"))


def good_lemma(lemma: Column) -> Column:
    """Not empty, no stop word, and a letter or digit first."""
    return (F.coalesce(lemma, F.lit("")) != "") & ~lemma.isin(*STOPWORDS) & lemma.rlike(r"^[\p{L}\p{N}]")


def stemmed_tokens(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", tagger=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(key, text) to key, *keep, pos, token, tag, stem: a row for each token, tags null without a tagger."""
    rows = docs.select(key, *keep, F.posexplode(tokenize(F.col("text"))).alias("pos", "token"))
    rows = rows.withColumn("tag", tagger(F.col("token")) if tagger else F.lit(None).cast("string"))
    table = stems(rows.select(F.col("token").alias("word"), "tag"), lexicon).select(F.col("word").alias("s_word"), F.col("tag").alias("s_tag"), "stem")
    return rows.join(table, (rows.token == F.col("s_word")) & rows.tag.eqNullSafe(F.col("s_tag"))).select(key, *keep, "pos", "token", "tag", "stem")


def normalize_list(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """docs(key, text), one row a key, to key, lemmas: good lemmas without a leading "to", or the text itself if none is good.

    Texts that share a key make one list, in the order of places; lemmas of one place are in the order of the columns ties of
    docs, nulls first, then of the lemmas themselves.
    """
    found = stemmed_tokens(docs, lexicon, key, keep=ties).where(good_lemma(F.col("stem")))
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *ties, "stem"))).alias("found"))
    lists = lists.select(F.col(key).alias("__key"), F.transform("found", lambda x: x["stem"]).alias("found"))
    rows = docs.select(key, "text").join(lists, F.col(key).eqNullSafe(F.col("__key")), "left")
    rest = F.when(F.get("found", F.lit(0)) == "to", F.slice("found", 2, F.greatest(F.size("found"), F.lit(1)))).otherwise(F.col("found"))
    return rows.select(key, F.when(F.col("found").isNotNull(), rest).otherwise(F.array("text")).alias("lemmas"))


def normalize(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    return normalize_list(docs, lexicon, key, ties).select(key, untokenize(F.col("lemmas")).alias("normalized"))


def tag_and_stem(docs: DataFrame, lexicon: Lexicon, tagger, key: str = "doc_id") -> DataFrame:
    """docs(key, text) to key, pos, stem, tag, token. tagger makes a tag column from a token column."""
    return stemmed_tokens(docs, lexicon, key, tagger).select(key, "pos", "stem", "tag", "token")


def baseline_tag(token: Column) -> Column:
    """Part-of-speech tags by closed classes and endings: a baseline for trying things out, no trained tagger."""
    low = F.lower(token)
    return (
        F.when(token.rlike(r"^[.?!]$"), ".").when(token.rlike(r"^[#]$"), "NN").when(token.rlike(r"^[^\p{L}\p{N}]+$"), token)
        .when(low.isin("the", "a", "an", "this", "that"), "DT").when(low.isin("i", "you", "he", "she", "it", "we", "they"), "PRP")
        .when(low.isin("can", "ca", "could", "will", "wo", "would", "should", "may", "must"), "MD").when(low.isin("not", "n't"), "RB")
        .when(low.isin("in", "on", "of", "for", "with", "at", "by", "from"), "IN").when(low.isin("and", "or", "but"), "CC").when(low == "to", "TO")
        .when(low.isin("big", "small", "good", "deep", "hot", "fast"), "JJ").when(token.rlike(r"^[\p{N}.,]+$"), "CD").when(token.rlike(r"^\p{Lu}"), "NNP")
        .when(low.endswith("ing"), "VBG").when(low.endswith("ed"), "VBD").when(low.endswith("ly"), "RB").when(low.endswith("s"), "NNS").otherwise("NN")
    )


def normalize_topic(topics: DataFrame, lexicon: Lexicon, key: str = "topic_id") -> DataFrame:
    """topics(key, topic) to key, name, disambig: the title's name, normalised, and its disambiguation as n/..., or null.

    Titles that share a key get one name of the words of all, by place; of one place, those of titles without disambiguation first.
    """
    rows = topics.select(key, topic_parts(F.col("topic")).alias("t"))
    named = rows.select(key, F.col("t.name").alias("text"), F.col("t.disambig").alias("__disambig"))
    names = normalize(named, lexicon, key, ("__disambig",)).select(F.col(key).alias("__key"), F.col("normalized").alias("name"))
    return rows.join(names, F.col(key).eqNullSafe(F.col("__key"))).select(key, "name", F.col("t.disambig").alias("disambig"))
