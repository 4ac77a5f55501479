import re
import sys

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from verbaflow import catalogue
from verbaflow.functions import text
from verbaflow.functions.tokenize import tokenize
from verbaflow.sources.analyzer import Protocol

ECHO = "import sys\nfor line in sys.stdin:\n    print(sys.argv[1] + line.strip())\n    print('EOS', flush=True)"
COLUMNS = {
    "render_safe(x)": lambda: text.render_safe(F.col("x")),
    "stripped(x)": lambda: text.stripped(F.col("x")),
    "tokens(x)": lambda: tokenize(F.col("x")),
    "untokenize(tokens(x))": lambda: text.untokenize(tokenize(F.col("x"))),
    "un_camel_case(x)": lambda: text.un_camel_case(F.col("x")),
    "string_pieces(x)": lambda: text.string_pieces(F.col("x")),
    "string_pieces(x, 7)": lambda: text.string_pieces(F.col("x"), 7),
    "is_punctuation(x)": lambda: text.is_punctuation(F.col("x")),
    "characters(x)": lambda: text.characters(F.col("x")),
    "topic_parts(x)": lambda: text.topic_parts(F.col("x")),
}
ODD = [None, "", " ", "\x01a\x7fb\n", "Mr. Smith can't 'go'. \"Why?\" (He said: no!) 3.14, ok...", "LinkedIn_2010HTMLParser", "Foo_bar_(n_x)_y", "!?", "日本語 é 𝒳", "a' b\\c $1 {2}", "word " * 3000]


@pytest.fixture(scope="module")
def rows(spark):
    catalogue.register(spark, {lang: Protocol((sys.executable, "-c", ECHO, lang), "EOS") for lang in ("xx", "yy")})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("text").alias("x"))
    docs.unionByName(spark.createDataFrame([(x,) for x in ODD], "x string")).createOrReplaceTempView("catalogue_rows")
    return spark.table("catalogue_rows")


@pytest.mark.parametrize("call", COLUMNS)
def test_functions_are_the_columns(spark, rows, call):
    by_sql = spark.sql(f"SELECT x, {call} AS y FROM catalogue_rows")
    by_column = rows.select("x", COLUMNS[call]().alias("y"))
    assert by_sql.exceptAll(by_column).isEmpty() and by_column.exceptAll(by_sql).isEmpty()


@pytest.mark.parametrize("call", [c for c in COLUMNS if c != "string_pieces(x)"])
def test_plans_are_those_of_the_columns(spark, rows, call):
    plan = lambda df: re.sub(r"#\d+L?|x_\d+|lambda [a-z_]+|\b[a-z]+_\d+\b", "", df._jdf.queryExecution().optimizedPlan().toString())
    by_sql, by_column = plan(spark.sql(f"SELECT {call} AS y FROM catalogue_rows")), plan(rows.select(COLUMNS[call]().alias("y")))
    assert "Python" not in by_sql
    assert by_sql.count("Project") == by_column.count("Project") and by_sql.count("regexp_replace") == by_column.count("regexp_replace")


@pytest.mark.parametrize("partitioned", ["", " PARTITION BY (lang, part)"])
def test_a_table_function_keeps_all_columns(spark, rows, partitioned):
    given = [("xx", ["a", "b"], 1), ("yy", ["c"], 2), ("zz", ["d"], 3), (None, ["e"], 4), ("xx", None, 5), ("xx", [], 6)] + [("yy", [str(i)], i) for i in range(10, 700)]
    df = spark.createDataFrame([(*g, g[2] % 3) for g in given], "lang string, pieces array<string>, n int, part int")
    df.createOrReplaceTempView("catalogue_given")
    out = spark.sql(f"SELECT * FROM analyzed(TABLE(catalogue_given){partitioned})")
    assert out.columns == ["lang", "pieces", "n", "part", "lines"]
    said = {r.n: r.lines for r in out.collect()}
    assert said == {n: None if p is None or lang not in ("xx", "yy") else [lang + x for x in p] for lang, p, n in given}
    assert spark.sql(f"SELECT * FROM analyzed(TABLE(SELECT * FROM catalogue_given WHERE n < 0){partitioned})").collect() == []


@pytest.mark.parametrize("given", ["TABLE(SELECT 'xx' AS lang)", "TABLE(SELECT 'xx' AS lang, array('a') AS pieces, 1 AS lines)", "1"])
def test_a_table_function_names_what_it_lacks(spark, rows, given):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM analyzed({given})").collect()
