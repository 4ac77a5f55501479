"""The engine's functions in a session's catalogue, for users of spark.sql.

Scalar functions are defined in SQL over Spark's own, so that Catalyst puts their bodies into the query and plans it like the
column API: nothing runs in Python. An analyzer is a table function, whose result has the columns of its input and one more:

    SELECT * FROM analyzed(TABLE(docs))
    SELECT * FROM analyzed(TABLE(docs) PARTITION BY (lang, part))

Without PARTITION BY rows stay where they are. Functions live as long as the session; null in, null out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions import text, tokenize
from .sources import analyzer

#: Rows of a partition that are sent to analyzers together.
AT_ONCE = 256


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(sql: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        sql = f"replace({sql}, {_quoted(old)}, {_quoted(new)})"
    return sql


def _substituted(sql: str, *changes: tuple[str, str]) -> str:
    for pattern, new in changes:
        sql = f"regexp_replace({sql}, {_quoted(pattern)}, {_quoted(new)})"
    return sql


def _stripped(sql: str) -> str:
    return _substituted(sql, (r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", ""))


def _untokenized(tokens: str) -> str:
    joined = _replaced(f"array_join({tokens}, ' ')", *text.QUOTES)
    return _stripped(_replaced(_substituted(joined, *text.MARKS), *text.CONTRACTIONS))


def _words_of_title(title: str) -> str:
    segments = f"regexp_extract_all(reverse({title}), {_quoted(text.SEGMENT)}, 1)"
    words = f"filter(transform({segments}, s -> btrim(s, ' _')), s -> s != '')"
    return _replaced(f"reverse(array_join({words}, ' '))", ("- ", "-"))


def _pieces(of: str, most: str) -> str:
    boundary = "".join(rf"\p{{{c}}}" for c in text.BOUNDARIES)
    parts = ["(?s)(?:.{1,", most, r"}\z|.{0,", f"{most} - 1", "}[" + boundary + "]|.{", most, "})"]
    pattern = ", ".join(p if p.startswith(most) else _quoted(p) for p in parts)
    return f"regexp_extract_all({of}, concat({pattern}), 0)"


def _topic(topic: str) -> str:
    spaced, shape = f"replace({topic}, '_', ' ')", _quoted(r"\A([^(]+) \(([^)]+)\)")
    part = lambda n: f"regexp_extract({spaced}, {shape}, {n})"
    name = f"CASE WHEN {spaced} RLIKE {shape} THEN {part(1)} ELSE {spaced} END"
    return f"named_struct('name', {name}, 'disambig', CASE WHEN {spaced} RLIKE {shape} THEN concat('n/', btrim({part(2)}, ' _')) END)"


def _tokens(of: str) -> str:
    rules = [(pattern, tokenize._template(new, "$")) for pattern, new in tokenize.RULES]
    return f"filter(split({_substituted(of, *rules)}, ' '), t -> t != '')"


#: (name, parameters, type, body) of each scalar function.
SCALARS = [
    ("render_safe", "x STRING", "STRING", _substituted("x", (text.UNSAFE, ""))),
    ("stripped", "x STRING", "STRING", _stripped("x")),
    ("tokens", "x STRING", "ARRAY<STRING>", _tokens("x")),
    ("untokenize", "x ARRAY<STRING>", "STRING", _untokenized("x")),
    ("un_camel_case", "x STRING", "STRING", _words_of_title("x")),
    ("string_pieces", f"x STRING, most INT DEFAULT {text.MAX_PIECE}", "ARRAY<STRING>", _pieces("x", "most")),
    ("is_punctuation", "x STRING", "BOOLEAN", f"NOT (x RLIKE {_quoted('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')})"),
    ("characters", "x STRING", "ARRAY<STRING>", "filter(split(x, ''), c -> c != '')"),
    ("topic_parts", "x STRING", "STRUCT<name: STRING, disambig: STRING>", _topic("x")),
]


def register(spark: SparkSession, protocols: Mapping[str, analyzer.Protocol] | None = None) -> list[str]:
    """Puts SCALARS into the session's catalogue and, if there are protocols for languages, the table function `analyzed`;
    functions of these names that the session made before are replaced. Returns the names."""
    for name, parameters, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    names = [s[0] for s in SCALARS]
    if protocols:
        spark.udtf.register("analyzed", analyzed(protocols))
        names.append("analyzed")
    return names


def analyzed(protocols: Mapping[str, analyzer.Protocol], by: str = "lang", given: str = "pieces", into: str = "lines", at_once: int = AT_ONCE):
    """A table function: its table's columns and `into`, array<string>, what the analyzer of the language in `by` answers to the
    lines in `given`. Rows without lines or of a language that there is no analyzer for get null. A partition has a process
    for each of its languages, and holds at_once rows at a time."""

    class Analyzed:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("analyzed takes a table: analyzed(TABLE(...))")
            kinds = {f.name: f.dataType for f in rows.dataType.fields}
            if kinds.get(by) != T.StringType() or kinds.get(given, None) not in (T.ArrayType(T.StringType()), T.ArrayType(T.StringType(), False)):
                raise ValueError(f"analyzed needs the columns {by} (string) and {given} (array<string>)")
            if into in kinds:
                raise ValueError(f"the table has a column {into} already")
            return AnalyzeResult(T.StructType([*rows.dataType.fields, T.StructField(into, T.ArrayType(T.StringType()))]))

        def __init__(self):
            self.processes: dict[str, analyzer.Process] = {}
            self.waiting: list = []

        def _answered(self) -> Iterator[tuple]:
            waiting, self.waiting = self.waiting, []
            said: dict[int, list[str]] = {}
            for which in {row[by] for row in waiting} & protocols.keys():
                asked = [(i, row[given]) for i, row in enumerate(waiting) if row[by] == which and row[given] is not None]
                process = self.processes.setdefault(which, analyzer.Process(protocols[which]))
                answers = iter(process.ask_each([line for _, lines in asked for line in lines]))
                said |= {i: [x for _ in lines for x in next(answers)] for i, lines in asked}
            for i, row in enumerate(waiting):
                yield (*row, said.get(i))

        def eval(self, rows) -> Iterator[tuple]:
            self.waiting.append(rows)
            if len(self.waiting) >= at_once:
                yield from self._answered()

        def terminate(self) -> Iterator[tuple]:
            yield from self._answered()

        def cleanup(self) -> None:
            for process in self.processes.values():
                process.close()
                if process.folder:
                    process.folder.cleanup()

    return udtf(Analyzed)
