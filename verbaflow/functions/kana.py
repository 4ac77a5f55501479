"""Kana: a table of syllables from the characters' Unicode names, and their spelling in Latin letters.

Romanization is a fold from left to right in the JVM. A piece stays open while a later character may rewrite it; when the
next piece begins it is respelled and closed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_KANA, KANA, NN, SMALL, SMALL_Y, SMALL_TSU, PROLONG = range(7)
BLOCKS = [(0x3041, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF), (0x1B000, 0x1B167)]

# Hepburn's spelling of the beginnings of romanized syllables.
HEPBURN = {
    "si": "shi", "sy": "sh", "ti": "chi", "ty": "ch", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "zy": "j", "dy": "j",
    "nm": "mm", "nb": "mb", "np": "mp", "a_": "aa", "e_": "ee", "i_": "ii", "o_": "ou", "u_": "uu",
}
# Latin signs for Japanese ones.
ROMAN_PUNCTUATION = {"・": ".", "。": ".", "、": ",", "！": "!", "「": "``", "」": "''", "？": "?", "〜": "~"}


def kana_info(char: str) -> tuple[str, int]:
    """The Latin spelling of one character, and its class."""
    words = unicodedata.name(char, "").split()
    if words[:2] not in (["HIRAGANA", "LETTER"], ["KATAKANA", "LETTER"]) and words[:1] != ["KATAKANA-HIRAGANA"]:
        return ROMAN_PUNCTUATION.get(char, char), NOT_KANA
    sound = words[-1].lower()
    if words[-2:] == ["SMALL", "TU"]:
        return "t", SMALL_TSU
    if words[-1] == "N":
        return "n", NN
    if words[1] == "PROLONGED":
        return "_", PROLONG
    if words[-2] == "SMALL":
        return "x" + sound, SMALL_Y if sound[0] == "y" else SMALL
    return sound, KANA


def kana_table(spark: SparkSession) -> DataFrame:
    """(ch, roman, cls) of every named character in the kana blocks."""
    chars = [chr(c) for low, high in BLOCKS for c in range(low, high + 1) if unicodedata.name(chr(c), "")]
    return spark.createDataFrame([(c, *kana_info(c)) for c in chars], "ch string, roman string, cls int")


def respell_hepburn(piece: Column) -> Column:
    """The native form: no spelling begins with another's key, so one step is enough."""
    pairs = F.create_map(*(F.lit(x) for kv in HEPBURN.items() for x in kv))
    new = F.try_element_at(pairs, F.left(piece, F.lit(2)))
    return F.when(new.isNotNull(), F.concat(new, F.substr(piece, F.lit(3)))).otherwise(piece)


def roman_punctuation(text: Column) -> Column:
    for old, new in ROMAN_PUNCTUATION.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _sounds(text: Column) -> Column:
    """array<struct<sound, kind>> of a text's characters."""
    known = {chr(c): kana_info(chr(c)) for low, high in BLOCKS for c in range(low, high + 1) if unicodedata.name(chr(c), "")} | {c: (r, NOT_KANA) for c, r in ROMAN_PUNCTUATION.items()}
    one = lambda sound, kind: F.struct(sound.alias("sound"), kind.alias("kind"))
    table = F.create_map(*(x for c, (sound, kind) in known.items() for x in (F.lit(c), one(F.lit(sound), F.lit(kind)))))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), one(c, F.lit(NOT_KANA))))


def _open_piece(piece: Column, before: Column, sound: Column, kind: Column, respell: Callable[[Column], Column]) -> tuple[Column, Column]:
    """What the next sound makes of the open piece, and whether it is part of that piece and begins none of its own."""
    first, last, but_last = F.left(sound, F.lit(1)), F.right(piece, F.lit(1)), lambda x: F.left(x, F.length(x) - 1)
    parted = (before == NN) & first.rlike(r"\p{L}") & ((kind != KANA) | first.isin(*"aeinouy"))
    piece = F.when(parted, F.concat(piece, F.lit("'"))).otherwise(piece)
    long = (kind == PROLONG) & before.isin(KANA, SMALL_Y, SMALL)
    glide = (kind == SMALL_Y) & (before == KANA) & (last == "i")
    doubled = F.when(first.isin(*"aeiouy"), "t-").otherwise(first)
    new = (
        F.when(long, F.concat(but_last(piece), respell(F.concat(F.right(piece, F.lit(1)), F.lit("_")))))
        .when(glide, F.concat(but_last(piece), F.substr(sound, F.lit(2))))
        .when((kind == KANA) & (before == SMALL_TSU), doubled)
        .when((kind == KANA) & (before == NN), but_last(respell(F.concat(piece, first))))
        .otherwise(piece)
    )
    return new, long | glide


def romanize(kana: Column, respell: Callable[[Column], Column] | None = respell_hepburn) -> Column:
    """The Latin spelling of a column of kana; other characters stay or become Latin signs, null gives null.

    respell: what is made of the spelling of each piece; None keeps the plain syllables.
    """
    short = respell in (None, respell_hepburn)  # these leave single characters as they are
    respell = respell or (lambda piece: piece)

    def step(state: Column, x: Column) -> Column:
        piece, within = _open_piece(state["piece"], state["before"], x["sound"], x["kind"], respell)
        closed = F.when(within, state["closed"]).otherwise(F.concat(state["closed"], respell(piece)))
        return F.struct(closed.alias("closed"), F.when(within, piece).otherwise(x["sound"]).alias("piece"), x["kind"].alias("before"))

    start = F.struct(F.lit("").alias("closed"), F.lit("").alias("piece"), F.lit(NOT_KANA).alias("before"))
    spelled = F.aggregate(_sounds(kana), start, step, lambda s: F.concat(s["closed"], respell(s["piece"])))
    strange = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in BLOCKS) + "".join(ROMAN_PUNCTUATION)
    # a text without any kana is spelled already
    text = F.when(kana.rlike(f"[{strange}]"), spelled).otherwise(kana) if short else spelled
    return F.regexp_replace(text, "[aeiou]x([aeiou])", "$1")
