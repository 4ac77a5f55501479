"""Sentences, and the abbreviations whose periods don't end one, learned from the texts themselves.

The statistics are those of Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006). A word is an
abbreviation if it comes with a period far more often than chance would have it (a likelihood ratio), is short, has periods
inside and seldom stands without its own. After an abbreviation or an initial a sentence begins only with a word that the
texts write in lower case and never with a capital inside of sentences.

Words are counted once for all languages; scores and decisions are columns and joins, so no list has to fit anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hmm import kept

BLANK = r"[\t-\r ]"
BLANKS = "\t\n\x0b\f\r "
#: Where a sentence may end: what ends it, the gap, and what the next one begins with.
CANDIDATE = rf"""([.!?]["')\]]*)({BLANK}+)(["'(\[]*\p{{Lu}})"""
#: Kept out of texts; it marks candidate ends.
MARK = "\x01"
#: What surrounds a word; a period at its end stays.
AROUND = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
ENDED = r"""[.!?]["')\]]*$"""
#: The share of an abbreviation's occurrences that have a period, and the score from which a word counts as one.
ALWAYS, LEAST_SCORE = 0.99, 0.3


def _core(word: Column) -> Column:
    return F.regexp_replace(word, AROUND, "")


def _form(core: Column) -> Column:
    return F.lower(F.regexp_replace(core, r"\.$", ""))


def word_statistics(texts: DataFrame) -> DataFrame:
    """texts(lang, text) to lang, form, n, n_period, n_lower, n_upper_inside: how often a word in lower case occurs, with a
    period, in lower case, and with a capital where no sentence begins. Null texts have no words."""
    # a line feed, which blanks no longer are, stands before a word that may begin a sentence: words are told apart by it
    # too, counted as they stand, and looked at once each
    plain = F.ltrim(F.translate("text", BLANKS, " " * len(BLANKS)))
    begun = F.regexp_replace(F.concat(F.lit("\n"), plain), rf"""{ENDED.removesuffix("$")} +""", "$0\n")
    rows = texts.select("lang", F.explode(F.split(begun, " ")).alias("w")).where(F.col("w") != "")
    rows = rows.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).select("lang", "w", "n", _core(F.col("w")).alias("core"))
    number = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    core = F.col("core")
    return rows.where(core != "").groupBy("lang", _form(core).alias("form")).agg(
        F.sum("n").alias("n"),
        number(core.endswith(".")).alias("n_period"),
        number(core.rlike(r"^\p{Ll}")).alias("n_lower"),
        number(core.rlike(r"^\p{Lu}") & ~F.col("w").startswith("\n")).alias("n_upper_inside"),
    )


def abbreviations(words: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """word_statistics to lang, form, n, n_period, score, for words of `least` or more. Words without a letter are none."""
    totals = words.groupBy("lang").agg((F.sum("n_period") / F.sum("n")).alias("p"))  # a row for each language
    n, k, p = F.col("n"), F.col("n_period"), F.col("p")
    ratio = 2 * (k * F.log(F.lit(ALWAYS)) + (n - k) * F.log(F.lit(1 - ALWAYS)) - k * F.log(p) - (n - k) * F.log(F.lit(1 + 1e-8) - p))
    inside = F.length(F.regexp_replace("form", r"[^.]+", ""))
    letters = (F.length("form") - inside).cast("double")
    score = ratio * F.exp(-letters) * (inside + 1) * F.pow(letters, -(n - k).cast("double"))
    rows = words.where((k > 0) & F.col("form").rlike(r"\p{L}")).join(F.broadcast(totals), "lang")
    return rows.withColumn("score", score).where(F.col("score") >= least).select("lang", "form", "n", "n_period", "score")


def starters(words: DataFrame) -> DataFrame:
    """(lang, form): words that a capital shows to begin a sentence."""
    return words.where("n_lower > 0 AND n_upper_inside = 0").select("lang", "form")


def candidates(text: Column) -> Column:
    """array<string>: the text, cut wherever a sentence may end; gaps stay with what follows them."""
    return F.split(F.regexp_replace(F.translate(text, MARK, ""), CANDIDATE, f"$1{MARK}$2$3"), MARK)


def false_ends(docs: DataFrame, key: str, words: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs(key, lang, text) to key, at: the candidate ends, counted from 0, that end no sentence. Only those after words with
    a period leave the texts, and of them only abbreviations and initials go further. Abbreviations are kept, so that Spark
    knows their size and sends a short list of them to the ends."""
    parts = candidates(F.translate("text", BLANKS, " " * len(BLANKS)))
    # a part ends in what ends it, and its gap is the next one's
    ends = F.transform(F.array(parts), lambda ps: F.transform(F.slice(ps, 1, F.size(ps) - 1), lambda p, i: F.struct(i.alias("at"), F.substring_index(p, " ", -1).alias("last"), F.get(ps, i + 1).alias("after"))))
    rows = docs.select(F.col(key).alias("key"), "lang", F.explode(F.filter(F.element_at(ends, 1), lambda e: F.contains(e["last"], F.lit(".")))).alias("e"))
    rows = rows.select("key", "lang", "e.at", _core(F.col("e.last")).alias("last"), F.substring_index(F.ltrim("e.after"), " ", 1).alias("after")).where(F.col("last").endswith("."))
    rows = rows.select("key", "lang", "at", _form(F.col("last")).alias("form"), F.col("last").rlike(r"^\p{Lu}\.$").alias("initial"), _form(_core(F.col("after"))).alias("next"))
    known = kept(abbreviations(words, least).select("lang", "form"), "abbreviations").withColumn("known", F.lit(True))
    short = rows.join(known, ["lang", "form"], "left").where("known OR initial").select("key", "lang", "at", F.col("next").alias("form"))
    return short.join(starters(words), ["lang", "form"], "left_anti").select("key", "at")


def sentences(docs: DataFrame, key: str, words: DataFrame | None = None, into: str = "sentences", least: float = LEAST_SCORE) -> DataFrame:
    """docs(key, lang, text, ...) with a further column, the array of the text's sentences without the gaps around them.

    words: word_statistics of texts to learn from, those of docs by default. Keys tell rows apart; rows with a null key or
    language are cut at every candidate. A null text gives null, an empty one no sentences.
    """
    words = kept(word_statistics(docs) if words is None else words, "words")  # they are read three times
    false = false_ends(docs.where(F.col(key).isNotNull()), key, words, least).groupBy(F.col("key").alias("__key")).agg(F.collect_set("at").alias("__false"))
    joined = docs.join(false, docs[key] == false["__key"], "left")
    ended = F.transform(candidates(F.col("text")), lambda p, i: F.when((i == 0) | F.array_contains("__false", i - 1), p).otherwise(F.concat(F.lit(MARK), p)))
    cut = F.when(F.col("__false").isNull(), candidates(F.col("text"))).otherwise(F.split(F.array_join(ended, ""), MARK))
    cut = F.transform(cut, lambda s: F.trim(s, F.lit(BLANKS)))
    return joined.withColumn(into, F.filter(cut, lambda s: s != "")).drop("__key", "__false")
