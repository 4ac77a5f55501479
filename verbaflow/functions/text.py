"""Scalar text functions as native columns: sanitising, joining, splitting and classifying strings.

Null in, null out. No function here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters other than tab, line feed and form feed, and private use beyond U+100000.
UNSAFE = r"[\x00-\x08\x0B\x0E-\x1F\x7F\x{100000}-\x{10FFFF}]"
# Results depend on these patterns and classes as they stand.
#: Read backwards, a segment of a joined-up title: see un_camel_case.
SEGMENT = r"([A-Z]+|[^A-Z0-9 _]+[A-Z _]|[^A-Z0-9 _]*[0-9.]+|[ _]+|[^A-Z0-9]*[^A-Z0-9_ ]+)"
#: Unicode categories after which a text may be cut. Opening punctuation is left out, so that it stays with what it opens.
BOUNDARIES = ("Cc", "Cf", "Cn", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Zl", "Zp", "Zs")
MAX_PIECE = 1024


def render_safe(text: Column) -> Column:
    """Drops what no text should hold; line breaks stay."""
    return F.regexp_replace(text, UNSAFE, "")


def stripped(text: Column) -> Column:
    """Without white space of any kind on either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def _replaced(text: Column, *changes: tuple[str, str]) -> Column:
    for old, new in changes:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# What becomes of joined tokens, in this order: replacements, patterns, replacements.
QUOTES = (("`` ", '"'), (" ''", '"'), (". . .", "..."), (" ( ", " ("), (" ) ", ") "))
MARKS = ((r""" ([.,:;?!%]+)([ '"`])""", "$1$2"), (r"(?d) ([.,:;?!%]+)$", "$1"))
CONTRACTIONS = ((" '", "'"), (" n't", "n't"), ("can not", "cannot"), (" ` ", " '"))


def untokenize(tokens: Column) -> Column:
    """Joins tokens with the spaces and quotes a reader expects."""
    text = _replaced(F.array_join(tokens, " "), *QUOTES)
    for pattern, new in MARKS:
        text = F.regexp_replace(text, pattern, new)
    return stripped(_replaced(text, *CONTRACTIONS))


def un_camel_case(text: Column) -> Column:
    """Spaces between the words of a title in CamelCase or with underscores.

    Segments are found from the end, so that a capital goes with the lower-case letters after it and the last of a
    run of capitals begins the next word. Only ASCII capitals count as such.
    """
    found = F.regexp_extract_all(F.reverse(text), F.lit(SEGMENT), F.lit(1))
    words = F.filter(F.transform(found, lambda x: F.btrim(x, F.lit(" _"))), lambda x: x != "")
    return F.replace(F.reverse(F.array_join(words, " ")), F.lit("- "), F.lit("-"))


def string_pieces(text: Column, maxlen: int = MAX_PIECE) -> Column:
    """Cuts text into pieces of at most maxlen characters, each as long as it can be, after a boundary character where
    there is one. The pieces joined are the text; an empty text has none."""
    if maxlen < 1:
        raise ValueError("maxlen must be 1 or more")
    boundary = "".join(rf"\p{{{c}}}" for c in BOUNDARIES)
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?:.{{1,{maxlen}}}\z|.{{0,{maxlen - 1}}}[{boundary}]|.{{{maxlen}}})"), F.lit(0))


def is_punctuation(text: Column) -> Column:
    """Whether no character is a letter, a mark-less number or part of one; true for an empty text."""
    return ~text.rlike(r"[\p{L}\p{N}]")


def characters(text: Column) -> Column:
    """The code points of a text, in order."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def topic_parts(topic: Column) -> Column:
    """struct<name, disambig> of a title such as Foo_(bar): the disambiguation as n/bar, null if there is none.

    What follows the closing parenthesis is ignored; the name is not yet normalised.
    """
    spaced = F.replace(topic, F.lit("_"), F.lit(" "))
    shape = r"\A([^(]+) \(([^)]+)\)"
    name = F.when(spaced.rlike(shape), F.regexp_extract(spaced, shape, 1)).otherwise(spaced)
    return F.struct(name.alias("name"), F.when(spaced.rlike(shape), F.concat(F.lit("n/"), F.btrim(F.regexp_extract(spaced, shape, 2), F.lit(" _")))).alias("disambig"))
