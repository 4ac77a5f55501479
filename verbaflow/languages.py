"""One set of operations for every language, whatever analyzes it, and the choice of a language by a column.

A Language turns docs(lang, text, ...) into records; all else follows from those. Languages of external analyzers say what
their process is given and how its answers are read, so that a table of many languages passes all processes at once.
English has operations of its own, which work from stems. Every operation returns docs with one further column.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import kana
from .functions.lexicon import Lexicon
from .operators import records, stem
from .sources import analyzer, freeling

OPERATIONS = ("analyze", "tokenize_list", "tokenize", "normalize_list", "normalize", "tag_and_stem", "is_stopword")
KEY = "__row"
#: What is made of the records of a text by each operation.
FROM_RECORDS: dict[str, Callable[[Column], Column]] = {
    "analyze": lambda r: r,
    "tokenize_list": records.tokens,
    "tokenize": lambda r: F.array_join(records.tokens(r), " "),
    "normalize_list": records.normalized_list,
    "normalize": records.normalized,
    "tag_and_stem": records.triples,
    "is_stopword": records.all_stop,
}


def text_key(text: Column) -> Column:
    """What stands for a text where rows are grouped or joined by it: 128 bits, whatever its length."""
    return F.unhex(F.md5(text))


@dataclass(frozen=True)
class Language:
    """records: adds the array of records, called __records, to docs. Where a process makes them: protocol, how to talk to it;
    given: the lines of a text that it gets; read: the records of its answer."""

    code: str
    records: Callable[[DataFrame], DataFrame]
    protocol: analyzer.Protocol | None = None
    given: Callable[[Column], Column] | None = None
    read: Callable[[Column], Column] | None = None

    def _with(self, docs: DataFrame, into: str, made: Callable[[Column], Column]) -> DataFrame:
        return self.records(docs).withColumn(into, made(F.col("__records"))).drop("__records")

    def analyze(self, docs: DataFrame, into: str = "analyze") -> DataFrame:
        return self._with(docs, into, FROM_RECORDS["analyze"])

    def tokenize_list(self, docs: DataFrame, into: str = "tokenize_list") -> DataFrame:
        return self._with(docs, into, FROM_RECORDS["tokenize_list"])

    def tokenize(self, docs: DataFrame, into: str = "tokenize") -> DataFrame:
        return self._with(docs, into, FROM_RECORDS["tokenize"])

    def normalize_list(self, docs: DataFrame, into: str = "normalize_list") -> DataFrame:
        return self._with(docs, into, FROM_RECORDS["normalize_list"])

    def normalize(self, docs: DataFrame, into: str = "normalize") -> DataFrame:
        return self._with(docs, into, FROM_RECORDS["normalize"])

    def tag_and_stem(self, docs: DataFrame, into: str = "tag_and_stem") -> DataFrame:
        return self._with(docs, into, FROM_RECORDS["tag_and_stem"])

    def is_stopword(self, docs: DataFrame, into: str = "is_stopword") -> DataFrame:
        return self._with(docs, into, FROM_RECORDS["is_stopword"])

    def phrases(self, docs: DataFrame, into: str = "phrases") -> DataFrame:
        return self._with(docs, into, records.phrases)

    def romanize(self, docs: DataFrame, into: str = "romanize") -> DataFrame:
        return self._with(docs, into, lambda r: kana.romanize(records.kana_of(r)))


@dataclass(frozen=True)
class English(Language):
    """Works from the stems of a lexicon; records are those of the tokens: stem, tag and whether the stem is a stop word."""

    lexicon: Lexicon | None = None
    tagger: Callable[[Column], Column] = stem.baseline_tag

    def normalize_list(self, docs: DataFrame, into: str = "normalize_list") -> DataFrame:
        return self._joined(docs, into, stem.normalize_list)

    def normalize(self, docs: DataFrame, into: str = "normalize") -> DataFrame:
        return self._joined(docs, into, stem.normalize)

    def _joined(self, docs: DataFrame, into: str, operation: Callable) -> DataFrame:
        """A row's own key is its text's digest, so that equal texts are worked on once."""
        made = operation(_texts(docs), self.lexicon, KEY).toDF(KEY, into)
        return docs.join(made, text_key(docs["text"]) == made[KEY], "left").drop(KEY)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").select(text_key(F.col("text")).alias(KEY), "text").dropDuplicates([KEY])


def english(lexicon: Lexicon, tagger: Callable[[Column], Column] = stem.baseline_tag) -> English:
    def add(docs: DataFrame) -> DataFrame:
        rows = stem.stemmed_tokens(_texts(docs), lexicon, KEY, tagger)
        none = F.lit(None).cast("string")
        one = F.struct(F.col("token").alias("surface"), F.col("stem").alias("root"), "tag", (~stem.good_lemma(F.col("stem"))).alias("is_stop"), none.alias("reading"), none.alias("pronunciation"))
        lists = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("r")))).alias("__list"))
        lists = lists.select(KEY, F.transform("__list", lambda x: x["r"]).alias("__records"))
        found = docs.join(lists, text_key(docs["text"]) == lists[KEY], "left").drop(KEY)
        return found.withColumn("__records", F.when(F.col("text").isNotNull(), F.coalesce("__records", F.array().cast(records.RECORDS))))

    return English("en", add, lexicon=lexicon, tagger=tagger)


def _by_process(code: str, protocol: analyzer.Protocol, given: Callable[[Column], Column], read: Callable[[Column], Column]) -> Language:
    def add(docs: DataFrame) -> DataFrame:
        lines = analyzer.analyzed(docs.withColumn("__pieces", given(F.col("text"))), protocol, "__pieces", "__lines")
        return lines.withColumn("__records", read(F.col("__lines"))).drop("__pieces", "__lines")

    return Language(code, add, protocol, given, read)


def japanese(protocol: analyzer.Protocol | None = None, stopwords: bool = True) -> Language:
    """By a MeCab process; without stop words, every word is content."""
    return _by_process("ja", protocol or analyzer.mecab(), analyzer.mecab_pieces, lambda lines: records.from_mecab(lines, stopwords))


def by_freeling(lang: str, protocol: analyzer.Protocol | None = None) -> Language:
    """By a FreeLing process."""
    return _by_process(lang, protocol or analyzer.freeling(lang), records.freeling_input, lambda lines: records.from_freeling(lines, F.lit(lang)))


def all_languages(lexicon: Lexicon | None = None) -> dict[str, Language]:
    """Every language there is an analyzer for; English by FreeLing unless there is a lexicon."""
    found: dict[str, Language] = {code: by_freeling(code) for code in freeling.LANGUAGES} | {"ja": japanese()}
    return found | ({"en": english(lexicon)} if lexicon else {})


def apply(docs: DataFrame, languages: Mapping[str, Language], operation: str, lang: str = "lang") -> DataFrame:
    """docs with a further column, named after one of OPERATIONS, each row by its own language; rows of languages that there
    is nothing for get null there."""
    if operation not in OPERATIONS:
        raise ValueError(f"no operation {operation!r}")
    piped = {code: language for code, language in languages.items() if language.protocol}
    own = {code: language for code, language in languages.items() if code not in piped}
    parts = [getattr(language, operation)(docs.where(F.col(lang) == code)) for code, language in own.items()]
    rest = docs.where(~F.coalesce(F.col(lang).isin(*own), F.lit(False))) if own else docs
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_piped(rest, piped, operation, lang), *parts])


def _piped(docs: DataFrame, languages: Mapping[str, Language], operation: str, lang: str) -> DataFrame:
    """One pass of docs through the processes of all languages."""
    if not languages:
        return docs

    def chosen(of: Callable[[Language], Column]) -> Column:
        said = F.lit(None)
        for code, language in languages.items():
            said = F.when(F.col(lang) == code, of(language)).otherwise(said)
        return said

    asked = docs.withColumn("__pieces", chosen(lambda x: x.given(F.col("text"))))
    lines = analyzer.analyzed_by(asked, {code: x.protocol for code, x in languages.items()}, lang, "__pieces", "__lines")
    found = lines.withColumn("__records", chosen(lambda x: x.read(F.col("__lines"))))
    return found.withColumn(operation, FROM_RECORDS[operation](F.col("__records"))).drop("__pieces", "__lines", "__records")
