"""Records of language analyzers: parsing their lines, and what is computed from the records of a text.

A text's records are one column, array<struct<surface, root, tag, is_stop, reading, pronunciation>> in text order, so
every operator here is a column expression without a shuffle and works on streams as on tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_punctuation, render_safe, stripped

RECORDS = "array<struct<surface: string, root: string, tag: string, is_stop: boolean, reading: string, pronunciation: string>>"
MECAB_FIELDS = ["pos", "subclass1", "subclass2", "subclass3", "conjugation", "form", "root", "reading", "pronunciation"]

# Japanese parts of speech, coarse or fine, whose words are stop words.
STOPWORD_CATEGORIES = ("助詞", "助動詞", "接続詞", "フィラー", "記号", "非自立")
# Japanese roots that are stop words.
STOPWORD_ROOTS = (
    "する", "為る", "くる", "来る", "いく", "行く", "いる", "居る", "ある", "有る", "もの", "物", "よう", "様", "れる",
    "これ", "それ", "あれ", "この", "その", "あの",
)
#: The root of negation, which is never a stop word.
NEGATION = "ない"


def mecab_input(text: Column) -> Column:
    """What a MeCab process is given: one line in lower case."""
    return F.lower(F.replace(render_safe(text), F.lit("\n"), F.lit(" ")))


def freeling_input(text: Column) -> Column:
    """The lines that a FreeLing process is given, without blank ones."""
    return F.filter(F.split(stripped(render_safe(text)), "\n"), lambda line: stripped(line) != "")


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value computed once however often it is used: lambdas get no common subexpressions."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _mecab_parts(lines: Column) -> Column:
    """Of each line the surface and the list of features, split once."""
    halves = F.transform(lines, lambda line: F.split(line, "\t"))
    return F.transform(halves, lambda h: F.struct(F.get(h, F.lit(0)).alias("surface"), F.split(F.get(h, F.lit(1)), ",").alias("info")))


def _mecab_fields(parts: Column) -> Column:
    field = {name: F.get(parts["info"], F.lit(i)) for i, name in enumerate(MECAB_FIELDS)}
    field["root"] = F.when((parts["surface"] == "ん") & (field["conjugation"] == "不変化型"), NEGATION).otherwise(field["root"])
    return F.struct(parts["surface"].alias("surface"), *(field[n].alias(n) for n in MECAB_FIELDS))


def mecab_record(line: Column) -> Column:
    """struct of the surface and nine features of a line `surface<TAB>features`; missing features are null.

    The contracted negative ん gets the root of the full one.
    """
    return F.element_at(F.transform(_mecab_parts(F.array(line)), _mecab_fields), 1)


def mecab_root(record: Column) -> Column:
    """The root, or the surface where the analyzer knows none."""
    return F.when(record["root"] != "*", record["root"]).otherwise(record["surface"])


def mecab_stop(record: Column, stopwords: bool = True) -> Column:
    """Whether the record is a stop word; with stopwords=False none is."""
    if not stopwords:
        return F.lit(False)
    root = mecab_root(record)
    said = record["pos"].isin(*STOPWORD_CATEGORIES) | F.coalesce(record["subclass1"].isin(*STOPWORD_CATEGORIES), F.lit(False)) | root.isin(*STOPWORD_ROOTS)
    return F.coalesce((root != NEGATION) & said, F.lit(False))


def _record(surface: Column, root: Column, tag: Column, stop: Column, reading: Column, pronunciation: Column) -> Column:
    return F.struct(surface.alias("surface"), root.alias("root"), tag.alias("tag"), stop.alias("is_stop"), reading.alias("reading"), pronunciation.alias("pronunciation"))


def from_mecab(lines: Column, stopwords: bool = True) -> Column:
    """Records of the lines of one text; tags of stop words begin with ~."""

    def told(r: Column) -> Column:
        return F.struct(r.alias("r"), mecab_root(r).alias("root"), mecab_stop(r, stopwords).alias("stop"))

    def one(t: Column) -> Column:
        r = t["r"]
        return _record(r["surface"], t["root"], F.when(t["stop"], F.concat(F.lit("~"), r["pos"])).otherwise(r["pos"]), t["stop"], r["reading"], r["pronunciation"])

    return F.transform(F.transform(F.transform(_mecab_parts(lines), _mecab_fields), told), one)


def _freeling_fields(parts: Column) -> Column:
    return F.struct(F.get(parts, F.lit(0)).alias("form"), F.get(parts, F.lit(1)).alias("lemma"), F.get(parts, F.lit(2)).alias("tag"), F.get(parts, F.lit(3)).try_cast("double").alias("prob"))


def freeling_record(line: Column) -> Column:
    """struct<form, lemma, tag, prob> of a line of space-separated fields."""
    return _once(F.split(line, " "), _freeling_fields)


def from_freeling(lines: Column, lang: Column) -> Column:
    """Records of the lines of one text. Lemmas are in lower case; tags are whole for English, else their first letter;
    determiners are the stop words."""
    none = F.lit(None).cast("string")

    def one(parts: Column) -> Column:
        form, lemma, tag = (F.get(parts, F.lit(i)) for i in range(3))
        return _record(form, F.lower(lemma), F.when(lang == "en", tag).otherwise(F.left(tag, F.lit(1))), tag.startswith("D"), none, none)

    return F.transform(F.transform(lines, lambda line: F.split(line, " ")), one)


def tokens(records: Column) -> Column:
    """array<string>: the surfaces."""
    return F.transform(records, lambda r: r["surface"])


def triples(records: Column) -> Column:
    """array<struct<stem, tag, token>>; punctuation is its own stem, tagged with a period; empty tokens are left out."""

    def one(r: Column) -> Column:
        said = lambda stem, tag: F.struct(stem.alias("stem"), tag.alias("tag"), r["surface"].alias("token"))
        return F.when(is_punctuation(r["surface"]), said(r["surface"], F.lit("."))).otherwise(said(r["root"], r["tag"]))

    return F.transform(F.filter(records, lambda r: r["surface"] != ""), one)


def content(records: Column) -> Column:
    return F.filter(records, lambda r: ~r["is_stop"])


def normalized_list(records: Column) -> Column:
    """The roots of all but stop words, or, if there is nothing else, all tokens."""

    def made(records: Column) -> Column:
        roots = F.transform(content(records), lambda r: F.coalesce(r["root"], r["surface"]))
        return _once(roots, lambda found: F.when(F.size(found) > 0, found).otherwise(tokens(records)))

    return _once(records, made)


def normalized(records: Column) -> Column:
    return F.array_join(normalized_list(records), " ")


def all_stop(records: Column) -> Column:
    """Whether a text is nothing but stop words; so is one without records."""
    return F.forall(records, lambda r: r["is_stop"])


def phrases(records: Column) -> Column:
    """array<struct<term, phrase>>: each content record's root and surface, and after it the pair with the next content
    record: both roots, and the surfaces from one to the other without spaces."""
    return _once(records, _phrases)


def _phrases(records: Column) -> Column:
    none = F.array().cast("array<int>")
    at = F.when(F.size(records) > 0, F.filter(F.sequence(F.lit(0), F.size(records) - 1), lambda i: ~F.get(records, i)["is_stop"])).otherwise(none)

    def paired(at: Column) -> Column:
        after = F.when(F.size(at) > 1, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(1)))).otherwise(none)
        return F.flatten(F.zip_with(at, after, one))

    def one(i: Column, j: Column) -> Column:
        r, s = F.get(records, i), F.get(records, j)
        single = F.struct(r["root"].alias("term"), r["surface"].alias("phrase"))
        span = F.slice(records, i + 1, F.coalesce(j - i + 1, F.lit(1)))
        pair = F.struct(F.concat(r["root"], F.lit(" "), s["root"]).alias("term"), F.array_join(F.transform(span, lambda x: x["surface"]), "").alias("phrase"))
        return F.when(j.isNull(), F.array(single)).otherwise(F.array(single, pair))

    return _once(at, paired)


def kana_of(records: Column) -> Column:
    """The text's sound: of each record the pronunciation, else the reading, else the surface, with spaces between."""
    blank = lambda c: F.nullif(c, F.lit(""))
    spoken = F.transform(records, lambda r: F.coalesce(blank(r["pronunciation"]), blank(r["reading"]), r["surface"]))
    return F.array_join(F.filter(spoken, lambda k: k != ""), " ")


def lemma_without_source(lemma: Column) -> Column:
    """A remote analyzer's lemma without what follows its last pipe character."""
    return F.regexp_replace(lemma, r"\|[^|]*$", "")
