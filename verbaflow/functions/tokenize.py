"""English tokens after the Penn Treebank conventions, as one chain of native replacements.

Sentence ends become a mark of their own first, because a period is a token only at the end of a sentence. Most
texts hold nothing that most of the rules are about: a rule goes over those only that hold one of its NEEDS, and texts of
words, single periods, commas and colons need one replacement in all.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"
#: (pattern, replacement), applied in order to all matches; {n} is group n. The patterns mean the same in Java and RE2.
RULES = [
    (r"^\s+|\s+$", ""),
    (r"""([.!?]["')\]]*)\s+(["'(\[]*\p{Lu})""", "{1}" + MARK + "{2}"),
    (r"""(^|[\x01 (\[{<])\"""", "{1} `` "),
    (r"([:,])([^0-9])", " {1} {2}"),
    (r"([:,])$", " {1}"),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", " {1} "),
    (r"""([^.])(\.)([\])}>"']*)\s*(\x01|$)""", "{1} {2}{3} {4}"),
    (r"([?!])", " {1} "),
    (r"([\]\[(){}<>])", " {1} "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"$", " "),
    (r"([^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T)([\x01 ])", "{1} {2}{3}"),
    (r"(?i)\b(can)(not)\b", " {1} {2} "),
    (r"[\x01\s]+", " "),
    (r"^ | $", ""),
]

#: What a text must hold one of for the rule in the same place to change it; an empty tuple if that can't be told so.
NEEDS = ((), (".", "!", "?"), ('"',), (":", ","), (":", ","), ("...",), tuple(";@#$%&"), (".",), ("?", "!"), tuple("][(){}<>"), ("--",), ('"',), (), ("'",), ("cannot",), (), ())
#: What a text must not hold for PLAIN to do the same as all rules; the last ones are ends of lines to Java.
UNPLAIN = (MARK, *"\"'?!;@#$%&][(){}<>", "--", "..", ",,", "::", ",:", ":,", "\x85", "\u2028", "\u2029")
PLAIN = (r"[:,](?![0-9])|\.(?=\s+\p{Lu}|\z)", " $0 ")
#: White space that one replacement leaves between tokens.
BLANKS = "\t\n\x0b\f\r"


def _template(text: str, sign: str) -> str:
    for n in "1234":
        text = text.replace("{" + n + "}", sign + n)
    return text


def rules(abbreviations: Sequence[str] = ()) -> list[tuple[str, str]]:
    """RULES, in which the periods of the given words (in lower case, without the last period) end no sentence."""
    if not abbreviations:
        return RULES
    known = "|".join(sorted((re.escape(a) for a in abbreviations), key=lambda a: (-len(a), a)))
    return [*RULES[:2], (rf"""(?i)(^|[\s\x01"'(\[])({known})\.\x01""", "{1}{2}. "), *RULES[2:]]


def tokenize(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """array<string>; an empty text has no tokens, a null one gives null. abbreviations: few words that a caller knows, or
    the best of operators.sentences.abbreviations; they are part of a pattern."""
    every = rules(abbreviations)
    needs = [*NEEDS[:2], *[(MARK,)] * (len(every) - len(RULES)), *NEEDS[2:]]
    # the last rule is about spaces at the ends, between which there are no tokens
    made = _once(text, lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(2))).rlike(r"\s"), F.regexp_replace(t, *RULES[0])).otherwise(t))

    def by_rules(text: Column) -> Column:
        for (pattern, new), needed in list(zip(every, needs, strict=True))[1:-1]:
            text = _once(text, lambda t: _changed(t, pattern, _template(new, "$"), needed))  # noqa: B023  called at once
        return text

    def plain(text: Column) -> Column:
        out = F.regexp_replace(text, *PLAIN)
        for blank in BLANKS:
            out = F.replace(out, F.lit(blank), F.lit(" "))
        return out

    if abbreviations:
        made = by_rules(made)
    else:
        made = _once(made, lambda t: F.when(_holds(t, UNPLAIN) | F.contains(F.lower(t), F.lit("cannot")), by_rules(t)).otherwise(plain(t)))
    return F.filter(F.split(made, " "), lambda t: t != "")


def _once(text: Column, made: Callable[[Column], Column]) -> Column:
    """made(text), which a plan holds once however often made uses it."""
    return F.element_at(F.transform(F.array(text), made), 1)


def _holds(text: Column, some: Sequence[str]) -> Column:
    return functools.reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in some))


def _changed(text: Column, pattern: str, new: str, needed: Sequence[str]) -> Column:
    out = F.regexp_replace(text, pattern, new)
    return F.when(_holds(F.lower(text) if needed == ("cannot",) else text, needed), out).otherwise(text) if needed else out


def tokenize_sql(text: str) -> str:
    """The same list of tokens in DuckDB SQL, for a SQL expression of the text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, new in RULES:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(_template(new, chr(92)))}, 'g')"
    return f"list_filter(string_split({text}, ' '), lambda t: t <> '')"
