"""Registered queries that reach the operators the way a user does: from spark.sql, and by the operations of a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalogue, languages
from ..functions.lexicon import STOPWORDS, Lexicon
from .registry import _BASELINE, _BOUNDARY, _JOINED, _SPLIT_TURNS, _STAND_INS, _TURNS, _camel_sql, _flat_sql, _table, _turns, _untokenized_sql, _values, _words, LONG, PIECE, PUNCT, TOKENS, registered, tokenize_sql

_TITLE = r"^([^(]+) \(([^)]+)\)"


@registered(f"""
SELECT doc_id, {_untokenized_sql("toks")} AS joined, {_camel_sql(_JOINED["documents"])} AS words, CAST(len(regexp_extract_all(text, '(?s)(?:.{{1,{PIECE}}}\\z|.{{0,{PIECE - 1}}}[{_BOUNDARY}]|.{{{PIECE}}})')) AS INTEGER) AS n_pieces,
 CAST(length(text) AS INTEGER) AS n_characters, {PUNCT.format("text")} AS is_mark, regexp_replace(chr(1) || text, '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F\\x{{100000}}-\\x{{10FFFF}}]', '', 'g') AS safe
FROM documents JOIN (SELECT doc_id, toks FROM ({TOKENS})) USING (doc_id)""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the session's catalogue over all documents, in SQL."""
    catalogue.register(spark)
    return spark.sql(
        """SELECT doc_id, untokenize(tokens(text)) AS joined, un_camel_case(replace(replace(text, ' ', ''), '\n', '')) AS words, size(string_pieces(text, :piece)) AS n_pieces,
        size(characters(text)) AS n_characters, is_punctuation(text) AS is_mark, render_safe(concat(char(1), text)) AS safe FROM {docs}""",
        {"piece": PIECE},
        docs=_table(spark, sf_dir, "documents"),
    )


@registered(f"""
SELECT p_partkey, CASE WHEN regexp_matches(s, '{_TITLE}') THEN regexp_extract(s, '{_TITLE}', 1) ELSE s END AS name, CASE WHEN regexp_matches(s, '{_TITLE}') THEN 'n/' || trim(regexp_extract(s, '{_TITLE}', 2), ' _') END AS disambig
FROM (SELECT p_partkey, replace(p_name || ' (' || p_type || ')', '_', ' ') AS s FROM part)""")
def sql_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles taken apart in SQL."""
    catalogue.register(spark)
    return spark.sql("SELECT p_partkey, t.name, t.disambig FROM (SELECT p_partkey, topic_parts(replace(concat(p_name, ' (', p_type, ')'), ' ', '_')) AS t FROM {parts})", parts=_table(spark, sf_dir, "part"))


@registered(f"SELECT doc_id, lang, CAST(len(ws) AS INTEGER) AS n_lines, array_to_string(list_transform(ws, lambda x: x || ' ' || x || CASE WHEN length(x) < 4 THEN ' DT' ELSE ' NN' END || ' 0.5'), '|') AS said FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'es' ELSE 'pt' END AS lang FROM ({_SPLIT_TURNS.format('text')}))")
def sql_analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through the table function, each by a process of its language. The last line of an answer is empty."""
    catalogue.register(spark, {lang: _STAND_INS["freeling"] for lang in ("es", "pt")})
    turns = _turns(spark, sf_dir).withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, "es").otherwise("pt"), "pieces": F.array(F.regexp_replace("text", "[\\n\\r]", " "))})
    return spark.sql("SELECT doc_id, lang, size(lines) AS n_lines, array_join(lines, '|') AS said FROM analyzed(TABLE(SELECT doc_id, lang, pieces FROM {turns}))", turns=turns)


def _english(spark: SparkSession) -> dict[str, languages.Language]:
    return {"en": languages.english(Lexicon.seed(spark))}


@registered(f"""
WITH RECURSIVE turns AS ({_TURNS}), {_flat_sql(_BASELINE)}, spoken AS (SELECT f.*, s.stem, {PUNCT.format("f.token")} AS mark FROM flat f JOIN stemmed s ON s.low = f.low AND s.pos IS NOT DISTINCT FROM f.sort)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN mark THEN token ELSE stem END AS stem, CASE WHEN mark THEN '.' ELSE tag END AS tag, token FROM spoken""")
def facade_tag_and_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by English's own tag_and_stem, a row for each triple."""
    docs = languages.apply(_turns(spark, sf_dir).withColumn("lang", F.lit("en")), _english(spark), "tag_and_stem")
    return docs.select("doc_id", F.posexplode("tag_and_stem").alias("pos", "t")).select("doc_id", "pos", "t.stem", "t.tag", "t.token")


@registered(f"SELECT doc_id, array_to_string(toks, ' ') AS tokens, CAST(len(toks) AS INTEGER) AS n FROM ({_TURNS})")
def facade_tokenize_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by English's own tokenize_list."""
    docs = languages.apply(_turns(spark, sf_dir).withColumn("lang", F.lit("en")), _english(spark), "tokenize_list")
    return docs.select("doc_id", F.array_join("tokenize_list", " ").alias("tokens"), F.size("tokenize_list").alias("n"))


@registered(f"""
WITH RECURSIVE turns AS (SELECT token AS doc_id, token AS text, {tokenize_sql('token')} AS toks FROM (SELECT DISTINCT token FROM ({LONG}))), {_flat_sql(_BASELINE)},
judged AS (SELECT f.doc_id, bool_and(s.stem IN ({_values([(w,) for w in sorted(STOPWORDS)]).replace("(", "").replace(")", "")}) OR NOT regexp_matches(s.stem, '^[\\p{{L}}\\p{{N}}]')) AS stop FROM flat f JOIN stemmed s ON s.low = f.low AND s.pos IS NOT DISTINCT FROM f.sort GROUP BY f.doc_id)
SELECT t.text AS word, coalesce(stop, true) AS is_stop FROM turns t LEFT JOIN judged j ON j.doc_id = t.doc_id""")
def facade_is_stopword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every distinct token of the documents, whether English takes it for a stop word."""
    words = _words(spark, sf_dir).distinct().select(F.col("token").alias("text"), F.lit("en").alias("lang"))
    return languages.apply(words, _english(spark), "is_stopword").select(F.col("text").alias("word"), F.col("is_stopword").alias("is_stop"))
