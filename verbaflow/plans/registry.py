"""Registered queries over the shared tables, and the DuckDB SQL that gives the same rows.

Every query runs over its whole tables. The tables hold no kana, so literal words are added where an operator is about
those; analyzer programs aren't at hand, so their lines are made from the tables' words, by columns or by a stand-in process.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import languages
from ..functions import frequency, kana, text
from ..functions.lexicon import AMBIGUOUS_EXCEPTIONS, DETACHMENTS, EXCEPTIONS, POS, SEED_EXCEPTIONS, SEED_LEMMAS, Lexicon
from ..functions.tokenize import tokenize, tokenize_sql
from ..operators import hmm, records, stem
from ..sources import analyzer, config, freeling, freqlist
from ..sources.texts import spread, stream_texts
from ..streaming import texts as streaming

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: What stands for a stop word in the records made from plain tokens.
STOP = ("the", "of", "and", "to", "in", "a", "an", "die", "der", "und", "de", "la", "que", "le", "les")
PIECE = 100
KANA_WORDS = [
    ("フジサン", "fujisan"), ("シンブン", "shimbun"), ("サンマ", "samma"), ("シンイチ", "shin'ichi"), ("コンニチワ", "kon'nichiwa"), ("トーキョー", "toukyou"),
    ("コーヒー", "kouhii"), ("チョット", "chotto"), ("マッチ", "matchi"), ("ッア", "t-a"), ("ー", "_"), ("ティー", "tii"), ("ファ", "fa"), ("フュ", "fuxyu"), ("ヅ", "du"),
]


def registered(sql: str | None = None):
    """Registers a query, and its SQL if there is any."""

    def keep(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


TOKENS = f"SELECT doc_id, lang, {tokenize_sql('text')} AS toks FROM documents"
LONG = f"SELECT doc_id, lang, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM ({TOKENS})"
STOPS = ", ".join(f"'{w}'" for w in STOP)
PUNCT = "NOT regexp_matches({}, '[\\p{{L}}\\p{{N}}]')"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", tokenize(F.col("text")).alias("toks"))


def _words(spark: SparkSession, sf_dir: str, *keep: str, pos: bool = False) -> DataFrame:
    """A row for each token: *keep, pos if asked for, token. The expression itself is exploded: of a named array Spark infers
    that it is neither null nor empty, and puts the whole chain of replacements into that filter again."""
    toks = tokenize(F.col("text"))
    return _table(spark, sf_dir, "documents").select(*keep, F.posexplode(toks).alias("pos", "token") if pos else F.explode(toks).alias("token"))


@registered(f"""
WITH w AS (SELECT lang, lower(token) AS word, count(*) AS n FROM ({LONG}) WHERE lower(token) NOT IN ('the', 'a', 'an') AND regexp_matches(lower(token), '^[\\p{{L}}\\p{{N}}]') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM w)
SELECT lang, word, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 100""")
def tokens_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent words of each language, stop words aside."""
    words = _words(spark, sf_dir, "lang").select("lang", F.lower("token").alias("word")).where(stem.good_lemma(F.col("word")))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    return counts.withColumn("place", place).where("place <= 100")


@registered(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM ({LONG})")
def tokens_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "doc_id", pos=True)


_SEGMENT = text.SEGMENT


def _camel_sql(column: str) -> str:
    return f"replace(reverse(array_to_string(list_filter(list_transform(regexp_extract_all(reverse({column}), '{_SEGMENT}', 1), lambda x: trim(x, ' _')), lambda x: x <> ''), ' ')), '- ', '-')"


_JOINED = {"documents": "replace(replace(text, ' ', ''), chr(10), '')", "nation": "n_name", "customer": "c_name"}


@registered(
    f"SELECT 'documents' AS origin, doc_id AS id, {_camel_sql(_JOINED['documents'])} AS words FROM documents"
    f" UNION ALL SELECT 'nation', n_nationkey, {_camel_sql('n_name')} FROM nation UNION ALL SELECT 'customer', c_custkey, {_camel_sql('c_name')} FROM customer"
)
def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, key: str, column: Column) -> DataFrame:
        return _table(spark, sf_dir, name).select(F.lit(name).alias("origin"), F.col(key).cast("long").alias("id"), text.un_camel_case(column).alias("words"))

    joined = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return part("documents", "doc_id", joined).unionByName(part("nation", "n_nationkey", F.col("n_name"))).unionByName(part("customer", "c_custkey", F.col("c_name")))


_BOUNDARY = "".join(f"\\p{{{c}}}" for c in text.BOUNDARIES if c != "Cn")


@registered(f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s)(?:.{{1,{PIECE}}}\\z|.{{0,{PIECE - 1}}}[{_BOUNDARY}]|.{{{PIECE}}})') AS pieces FROM documents)
SELECT doc_id, CAST(unnest(range(len(pieces))) AS INTEGER) AS pos, unnest(pieces) AS piece FROM p""")
def pieces_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.string_pieces(F.col("text"), PIECE)).alias("pos", "piece"))


@registered(f"SELECT token, {PUNCT.format('token')} AS is_punct, count(*) AS n FROM ({LONG}) GROUP BY ALL")
def punct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.select("token", text.is_punctuation(F.col("token")).alias("is_punct"), "n")


def _untokenized_sql(words: str) -> str:
    out = f"array_to_string({words}, ' ')"
    for old, new in (("`` ", '"'), (" ''", '"'), (". . .", "..."), (" ( ", " ("), (" ) ", ") ")):
        out = f"replace({out}, {_values([(old,)])[1:-1]}, {_values([(new,)])[1:-1]})"
    out = f"""regexp_replace({out}, ' ([.,:;?!%]+)([ ''"`])', '\\1\\2', 'g')"""
    out = f"regexp_replace({out}, ' ([.,:;?!%]+)$', '\\1')"
    for old, new in ((" '", "'"), (" n't", "n't"), ("can not", "cannot"), (" ` ", " '")):
        out = f"replace({out}, {_values([(old,)])[1:-1]}, {_values([(new,)])[1:-1]})"
    return f"trim({out})"


@registered(f"SELECT doc_id, {_untokenized_sql('toks')} AS text FROM ({TOKENS})")
def untok_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", text.untokenize(F.col("toks")).alias("text"))


@registered("""
SELECT conv_id, turn, regexp_replace(chr(1) || text || chr(127) || chr(10) || chr(11) || 'x', '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F\\x{100000}-\\x{10FFFF}]', '', 'g') AS safe FROM conversations""")
def render_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("\x01"), F.col("text"), F.lit("\x7f\n\x0bx"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.render_safe(dirty).alias("safe"))


@registered("""
WITH t AS (SELECT p_partkey, replace(replace(p_name, ' ', '_') || ' (' || p_type || '_) x', '_', ' ') AS s FROM part
           UNION ALL SELECT -p_partkey, replace(p_name, '_', ' ') FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(s, '^([^(]+) \\(([^)]+)\\)') THEN regexp_extract(s, '^([^(]+) \\(([^)]+)\\)', 1) ELSE s END AS name,
       CASE WHEN regexp_matches(s, '^([^(]+) \\(([^)]+)\\)') THEN 'n/' || trim(regexp_extract(s, '^([^(]+) \\(([^)]+)\\)', 2), ' _') END AS disambig FROM t""")
def topic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    titled = part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" ("), "p_type", F.lit("_) x")).alias("topic"))
    rows = titled.unionByName(part.select((-F.col("p_partkey")).alias("p_partkey"), F.col("p_name").alias("topic")))
    return rows.select("p_partkey", text.topic_parts(F.col("topic")).alias("t")).select("p_partkey", "t.name", "t.disambig")


_LEMMAS = [(f, p) for p, forms in SEED_LEMMAS.items() for f in forms]
_BADNESS = "length(form) - CASE WHEN ends_with(form, 'e') THEN 2 WHEN ends_with(form, 'ess') THEN 10 WHEN ends_with(form, 'ss') THEN 4 ELSE 0 END"


#: SQL: the part of speech that a word's tag names, by the rules of stem.assumed_pos.
_POS = """CASE WHEN (({tag}) IS NULL AND ends_with(low, 'ing')) OR ends_with(low, 'ed') THEN 'v' WHEN starts_with({tag}, 'NN') THEN 'n' WHEN starts_with({tag}, 'VB') THEN 'v'
 WHEN starts_with({tag}, 'JJ') THEN 'a' WHEN starts_with({tag}, 'RB') THEN 'r' WHEN contains('nvar', {tag}) THEN {tag} END"""
_NO_TAG = "CAST(NULL AS VARCHAR)"


def _stem_ctes(words: str, more: str = "SELECT NULL, NULL WHERE false") -> str:
    """SQL: CTEs that end in stemmed(low, pos, stem), for a query of words (low, pos); they stand after WITH RECURSIVE. more: a
    query of lemmas (form, p) beside those of the seed."""
    return f"""
words AS MATERIALIZED (SELECT DISTINCT low, pos FROM ({words})), lemmas(form, p) AS (SELECT * FROM (VALUES {_values(_LEMMAS)}) UNION {more}), odd(low, p, form) AS (VALUES {_values(SEED_EXCEPTIONS)}),
rules(p, old, new) AS (VALUES {_values(DETACHMENTS)}), letters(p, p_at) AS (VALUES {_values([(p, k) for k, p in enumerate(POS)])}),
fixed(low, stem) AS (VALUES {_values(list(EXCEPTIONS.items()))}), loose(low, stem) AS (VALUES {_values(list(AMBIGUOUS_EXCEPTIONS.items()))}),
asked AS MATERIALIZED (SELECT w.low, w.pos, l.p, l.p_at FROM words w JOIN letters l ON contains(coalesce(w.pos, 'nvar'), l.p)),
made AS (SELECT a.low, a.pos, a.p, a.p_at, 1 AS round, left(a.low, length(a.low) - length(r.old)) || r.new AS form FROM asked a JOIN rules r ON r.p = a.p AND ends_with(a.low, r.old)
         UNION ALL SELECT a.low, a.pos, a.p, a.p_at, a.round + 1, left(a.form, length(a.form) - length(r.old)) || r.new FROM made a JOIN rules r ON r.p = a.p AND ends_with(a.form, r.old)),
pool AS (SELECT low, pos, p, p_at, 1 AS round, 0 AS own, low AS form FROM asked
         UNION ALL SELECT low, pos, p, p_at, round, 1, form FROM made ANTI JOIN odd USING (low, p)
         UNION ALL SELECT a.low, a.pos, a.p, a.p_at, 1, 1, o.form FROM asked a JOIN odd o ON o.low = a.low AND o.p = a.p),
known AS (SELECT pool.*, {_BADNESS} AS badness FROM pool SEMI JOIN lemmas USING (form, p)),
early AS (SELECT * FROM known QUALIFY round = min(round) OVER (PARTITION BY low, pos, p)),
best AS (SELECT low, pos, first(form ORDER BY badness, p_at, own, form) AS form FROM early GROUP BY low, pos),
stemmed AS MATERIALIZED (SELECT w.low, w.pos, coalesce(f.stem, l.stem, b.form, w.low) AS stem FROM words w LEFT JOIN fixed f ON f.low = w.low
            LEFT JOIN loose l ON l.low = w.low AND w.pos IS NULL LEFT JOIN best b ON b.low = w.low AND b.pos IS NOT DISTINCT FROM w.pos)"""


_TURNS = f"SELECT conv_id * 1000 + turn AS doc_id, text, {tokenize_sql('text')} AS toks FROM conversations"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


@registered(f"""
WITH RECURSIVE {_stem_ctes(f"SELECT low, {_POS.format(tag=_NO_TAG)} AS pos FROM (SELECT DISTINCT lower(t) AS low FROM (SELECT unnest(toks) AS t FROM ({TOKENS})))")}
SELECT low AS word, stem FROM stemmed""")
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every distinct lower-case token, tags unknown."""
    words = hmm.kept(_words(spark, sf_dir).select(F.lower("token").alias("word")).distinct(), "words")
    return stem.stems(words.withColumn("tag", F.lit(None).cast("string")), Lexicon.seed(spark)).select("word", "stem")


@registered(f"SELECT token AS form, CAST({_BADNESS.replace('form', 'token')} AS INTEGER) AS badness, count(*) AS n FROM ({LONG}) GROUP BY ALL")
def badness(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).groupBy(F.col("token").alias("form")).agg(F.count(F.lit(1)).alias("n"))
    return words.select("form", stem.word_badness(F.col("form")).alias("badness"), "n")


def _flat_sql(tag: str) -> str:
    """SQL: CTEs flat(doc_id, pos, token, low, tag, sort) of turns(doc_id, text, toks), and stemmed(low, pos, stem)."""
    return f"""
flat AS MATERIALIZED (SELECT *, {_POS.format(tag="tag")} AS sort FROM (SELECT doc_id, pos, token, lower(token) AS low, {tag} AS tag FROM (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM turns))),
{_stem_ctes("SELECT low, sort AS pos FROM flat")}"""


def _lists_sql(turns: str) -> str:
    """SQL: CTEs that end in lists(doc_id, lemmas), for a query of texts (doc_id, text, toks)."""
    return f"""
turns AS ({turns}), {_flat_sql(_NO_TAG)},
good AS (SELECT f.doc_id, list(s.stem ORDER BY f.pos) AS found FROM flat f JOIN stemmed s ON s.low = f.low
         WHERE s.stem NOT IN ('the', 'a', 'an') AND regexp_matches(s.stem, '^[\\p{{L}}\\p{{N}}]') GROUP BY f.doc_id),
lists AS (SELECT t.doc_id, CASE WHEN g.found IS NULL THEN [t.text] WHEN g.found[1] = 'to' THEN g.found[2:] ELSE g.found END AS lemmas FROM turns t LEFT JOIN good g ON g.doc_id = t.doc_id)"""


@registered(f"WITH RECURSIVE {_lists_sql(_TURNS)} SELECT doc_id, array_to_string(lemmas, '|') AS lemmas FROM lists")
def normalize_list_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stem.normalize_list(_turns(spark, sf_dir), Lexicon.seed(spark)).select("doc_id", F.array_join("lemmas", "|").alias("lemmas"))


@registered(f"WITH RECURSIVE {_lists_sql(_TURNS)} SELECT doc_id, {_untokenized_sql('lemmas')} AS normalized FROM lists")
def normalize_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stem.normalize(_turns(spark, sf_dir), Lexicon.seed(spark))


_TITLES = "SELECT p_partkey AS doc_id, s, CASE WHEN regexp_matches(s, '^([^(]+) \\(([^)]+)\\)') THEN regexp_extract(s, '^([^(]+) \\(([^)]+)\\)', 1) ELSE s END AS text FROM t"


@registered(f"""
WITH RECURSIVE t AS (SELECT p_partkey, replace('the ' || p_name || 's', '_', ' ') || ' (' || p_type || ') x' AS s FROM part UNION ALL SELECT -p_partkey, replace(p_name, '_', ' ') FROM part),
titles AS ({_TITLES}), {_lists_sql(f"SELECT doc_id, text, {tokenize_sql('text')} AS toks FROM titles")}
SELECT doc_id AS p_partkey, {_untokenized_sql('lemmas')} AS name, CASE WHEN regexp_matches(s, '^([^(]+) \\(([^)]+)\\)') THEN 'n/' || trim(regexp_extract(s, '^([^(]+) \\(([^)]+)\\)', 2), ' _') END AS disambig
FROM lists JOIN titles USING (doc_id)""")
def normalize_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    titled = part.select("p_partkey", F.concat(F.lit("the_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("s_("), "p_type", F.lit(")_x")).alias("topic"))
    rows = titled.unionByName(part.select((-F.col("p_partkey")).alias("p_partkey"), F.col("p_name").alias("topic")))
    return stem.normalize_topic(rows, Lexicon.seed(spark), "p_partkey")


#: SQL: the tags of stem.baseline_tag.
_BASELINE = """CASE WHEN regexp_matches(token, '^[.?!]$') THEN '.' WHEN token = '#' THEN 'NN' WHEN regexp_matches(token, '^[^\\p{L}\\p{N}]+$') THEN token
 WHEN lower(token) IN ('the', 'a', 'an', 'this', 'that') THEN 'DT' WHEN lower(token) IN ('i', 'you', 'he', 'she', 'it', 'we', 'they') THEN 'PRP'
 WHEN lower(token) IN ('can', 'ca', 'could', 'will', 'wo', 'would', 'should', 'may', 'must') THEN 'MD' WHEN lower(token) IN ('not', 'n''t') THEN 'RB'
 WHEN lower(token) IN ('in', 'on', 'of', 'for', 'with', 'at', 'by', 'from') THEN 'IN' WHEN lower(token) IN ('and', 'or', 'but') THEN 'CC' WHEN lower(token) = 'to' THEN 'TO'
 WHEN lower(token) IN ('big', 'small', 'good', 'deep', 'hot', 'fast') THEN 'JJ' WHEN regexp_matches(token, '^[\\p{N}.,]+$') THEN 'CD' WHEN regexp_matches(token, '^\\p{Lu}') THEN 'NNP'
 WHEN ends_with(lower(token), 'ing') THEN 'VBG' WHEN ends_with(lower(token), 'ed') THEN 'VBD' WHEN ends_with(lower(token), 'ly') THEN 'RB' WHEN ends_with(lower(token), 's') THEN 'NNS' ELSE 'NN' END"""


@registered(f"""
WITH RECURSIVE turns AS ({_TURNS}), {_flat_sql(_BASELINE)}
SELECT f.doc_id, CAST(f.pos AS INTEGER) AS pos, s.stem, f.tag, f.token FROM flat f JOIN stemmed s ON s.low = f.low AND s.pos IS NOT DISTINCT FROM f.sort""")
def tag_and_stem_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stem.tag_and_stem(_turns(spark, sf_dir), Lexicon.seed(spark), stem.baseline_tag)


def _as_records(toks: Column) -> Column:
    """Records as a FreeLing analyzer gives them, its lines made from plain tokens: the lemma in place, determiners for STOP."""
    line = lambda t: F.concat_ws(" ", t, t, F.when(F.lower(t).isin(*STOP), "DT").otherwise("NN"), F.lit("1"))
    return records.from_freeling(F.transform(toks, line), F.col("lang"))


_TAG = f"CASE WHEN lower(token) IN ({STOPS}) THEN CASE WHEN lang = 'en' THEN 'DT' ELSE 'D' END ELSE CASE WHEN lang = 'en' THEN 'NN' ELSE 'N' END END"


@registered(f"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN {PUNCT.format('token')} THEN token ELSE lower(token) END AS stem,
       CASE WHEN {PUNCT.format('token')} THEN '.' ELSE {_TAG} END AS tag, token FROM ({LONG})""")
def records_tag_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).select("doc_id", F.posexplode(records.triples(_as_records(F.col("toks")))).alias("pos", "t"))
    return rows.select("doc_id", "pos", "t.stem", "t.tag", "t.token")


@registered(f"""
SELECT doc_id, CASE WHEN len(list_filter(toks, lambda t: lower(t) NOT IN ({STOPS}))) > 0
  THEN array_to_string(list_transform(list_filter(toks, lambda t: lower(t) NOT IN ({STOPS})), lambda t: lower(t)), ' ') ELSE array_to_string(toks, ' ') END AS normalized FROM ({TOKENS})""")
def records_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", records.normalized(_as_records(F.col("toks"))).alias("normalized"))


@registered(f"""
WITH c AS (SELECT doc_id, pos, token, lower(token) AS root, lead(lower(token)) OVER w AS next_root, lead(pos) OVER w AS next_pos
           FROM ({LONG}) WHERE lower(token) NOT IN ({STOPS}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT doc_id, pos, 1 AS n, root AS term, token AS phrase FROM c
      UNION ALL SELECT c.doc_id, c.pos, 2, root || ' ' || next_root, array_to_string(t.toks[c.pos + 1 : c.next_pos + 1], '') FROM c JOIN ({TOKENS}) t ON t.doc_id = c.doc_id WHERE next_pos IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, n) - 1 AS INTEGER) AS pos, term, phrase FROM p""")
def phrases_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).select("doc_id", F.posexplode(records.phrases(_as_records(F.col("toks")))).alias("pos", "p"))
    return rows.select("doc_id", "pos", "p.term", "p.phrase")


@registered(f"""
WITH lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, len(list_filter({tokenize_sql('line')}, lambda t: lower(t) NOT IN ({STOPS}))) = 0 AS all_stop FROM lines""")
def is_stop_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line of text is nothing but stop words."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", records.all_stop(_as_records(tokenize(F.col("line")))).alias("all_stop"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, word, n): how often each token occurs in a language. It is kept, so that texts are tokenized once."""
    return hmm.kept(_words(spark, sf_dir, "lang").groupBy("lang", F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("n")), "counts")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists_of(word_counts(spark, sf_dir))


def lists_of(counts: DataFrame) -> DataFrame:
    """word_counts to lang, rank, freq, word: a frequency list of each language, read from lines as its file has them: some
    before the list, then rank, frequency and word."""
    spark = counts.sparkSession
    lines = frequency.ranked(counts, "lang").select("lang", F.concat_ws(" ", F.col("rank").cast("string"), F.format_string("%d.%02d", F.col("n"), F.col("n") % 100), "word").alias("value"))
    head = spark.createDataFrame([("de", "The frequency distribution of a corpus"), ("en", " - lexicon size: 1 type")], "lang string, value string")
    return frequency.parse_list(head.unionByName(lines), "lang")


_RANKED = f"""
counted AS (SELECT lang, token AS word, count(*) AS n FROM ({LONG}) GROUP BY ALL),
listed AS (SELECT lang, word, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rank, CAST(n || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') AS DECIMAL(12, 2)) AS freq FROM counted)"""


@registered(f"WITH {_RANKED} SELECT lang, rank, freq, word FROM listed")
def freq_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir)


@registered(f"WITH {_RANKED} SELECT lang, lower(word) AS word, sum(freq) AS freq FROM listed GROUP BY ALL")
def freq_renormalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.renormalized(_lists(spark, sf_dir), F.lower, "lang")


@registered(f"""
WITH {_RANKED}, scaled AS (SELECT word, CAST(freq AS DOUBLE) * 1e9 / (sum(CAST(freq AS DOUBLE)) OVER (PARTITION BY lang)) AS freq FROM listed)
SELECT word, CAST(round(sum(freq), 2) AS DECIMAL(18, 2)) AS freq FROM scaled GROUP BY word""")
def freq_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of all languages as one, each of the same mass."""
    return frequency.merged_lists(_lists(spark, sf_dir), "lang").select("word", F.round("freq", 2).cast("decimal(18,2)").alias("freq"))


@registered(f"WITH {_RANKED} SELECT lang, word, CAST(round(log10(CAST(freq AS DOUBLE)), 4) AS DECIMAL(9, 4)) AS freq FROM listed")
def freq_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("lang", "word", frequency.logarithmic(F.col("freq")).cast("decimal(9,4)").alias("freq"))


@registered(f"WITH {_RANKED} SELECT lang, CAST(sum(freq) AS DECIMAL(18, 2)) AS total, count(*) AS n, CAST(round(avg(CAST(freq AS DOUBLE)), 6) AS DECIMAL(18, 6)) AS mean FROM listed GROUP BY lang")
def freq_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = frequency.average(_lists(spark, sf_dir), "lang")
    return one.select("lang", F.col("total").cast("decimal(18,2)").alias("total"), "n", F.round("mean", 6).cast("decimal(18,6)").alias("mean"))


@registered(f"""
WITH {_RANKED}, asked AS (SELECT DISTINCT lang, lower(token) AS word FROM ({LONG}))
SELECT a.lang, a.word, CAST(coalesce(CAST(l.freq AS DOUBLE), 0) AS DOUBLE) AS freq FROM asked a LEFT JOIN listed l ON l.lang = a.lang AND l.word = a.word""")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every lower-case word of a language, the frequency in that language's list."""
    counts = word_counts(spark, sf_dir)
    words = counts.select("lang", F.lower("word").alias("word")).distinct()
    return frequency.word_frequency(words, lists_of(counts), keys=("lang",))


@registered("""
SELECT doc_id, CAST(unnest(range(len(cs))) AS INTEGER) AS pos, unnest(cs) AS ch FROM (SELECT page_id AS doc_id, regexp_extract_all(url, '(?s).') AS cs FROM pages)""")
def char_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(text.characters(F.col("url"))).alias("pos", "ch"))


#: SQL: the kana of the syllabary in its order, a row of vowels for each consonant, from the first code point of the table on.
_SYLLABARY = """
chars AS (
  SELECT 12353 + 2 * i + small AS code, CASE WHEN small = 0 THEN 'x' ELSE '' END || 'aiueo'[i + 1] AS roman, CASE WHEN small = 0 THEN 3 ELSE 1 END AS cls FROM range(5) r(i), (VALUES (0), (1)) s(small)
  UNION ALL SELECT 12363 + 10 * row + 2 * i + voiced, CASE WHEN voiced = 0 THEN 'kst'[row + 1] ELSE 'gzd'[row + 1] END || 'aiueo'[i + 1], 1 FROM range(2) a(row), range(5) r(i), (VALUES (0), (1)) s(voiced)
  UNION ALL SELECT 12383 + 2 * i + voiced + (CASE WHEN i > 1 THEN 1 ELSE 0 END), CASE WHEN voiced = 0 THEN 't' ELSE 'd' END || 'aiueo'[i + 1], 1 FROM range(5) r(i), (VALUES (0), (1)) s(voiced)
  UNION ALL SELECT 12387, 't', 5
  UNION ALL SELECT 12394 + i, 'n' || 'aiueo'[i + 1], 1 FROM range(5) r(i)
  UNION ALL SELECT 12399 + 3 * i + kind, 'hbp'[kind + 1] || 'aiueo'[i + 1], 1 FROM range(5) r(i), range(3) k(kind)
  UNION ALL SELECT 12414 + i, 'm' || 'aiueo'[i + 1], 1 FROM range(5) r(i)
  UNION ALL SELECT 12419 + 2 * i + small, CASE WHEN small = 0 THEN 'xy' ELSE 'y' END || 'auo'[i + 1], CASE WHEN small = 0 THEN 4 ELSE 1 END FROM range(3) r(i), (VALUES (0), (1)) s(small)
  UNION ALL SELECT 12425 + i, 'r' || 'aiueo'[i + 1], 1 FROM range(5) r(i)
  UNION ALL SELECT * FROM (VALUES (12430, 'xwa', 3), (12431, 'wa', 1), (12432, 'wi', 1), (12433, 'we', 1), (12434, 'wo', 1), (12435, 'n', 2), (12436, 'vu', 1), (12437, 'xka', 3), (12438, 'xke', 3))
), kana AS (SELECT chr(CAST(base + c.code - 12353 AS INTEGER)) AS ch, c.roman, c.cls FROM (VALUES (12353), (12449)) b(base), chars c), others(ch, roman, cls) AS (VALUES ('ヷ', 'va', 1), ('ヸ', 'vi', 1), ('ヹ', 've', 1), ('ヺ', 'vo', 1), ('ー', '_', 6), ('゠', 'hyphen', 1))"""


@registered(f"WITH {_SYLLABARY} SELECT ch, roman, CAST(cls AS INTEGER) AS cls FROM kana UNION ALL SELECT * FROM others")
def kana_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kana that the two syllabaries hold: all of the table but signs that are no letters, ligatures, and the
    additions for other languages."""
    code = F.ascii("ch")
    letters = code.between(0x3041, 0x3096) | code.between(0x30A0, 0x30FA) | (code == 0x30FC)
    return kana.kana_table(spark).where(letters)


@registered(f"""
SELECT 'documents' AS origin, CAST(doc_id AS VARCHAR) AS id, regexp_replace(text, '[aeiou]x([aeiou])', '\\1', 'g') AS roman FROM documents
UNION ALL SELECT 'words', kana, regexp_replace(roman || ' ' || roman, '[aeiou]x([aeiou])', '\\1', 'g') FROM (VALUES {_values(KANA_WORDS)}) t(kana, roman)""")
def romanize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, none of which holds kana, and words that do, twice each."""
    texts = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"), "text")
    words = spark.createDataFrame([("words", w, f"{w} {w}") for w, _ in KANA_WORDS], texts.schema)
    return texts.unionByName(words).select("origin", "id", kana.romanize(F.col("text")).alias("roman"))


_MECAB = [("これ", "名詞,代名詞,一般,*,*,*,これ,コレ,コレ"), ("は", "助詞,係助詞,*,*,*,*,は,ハ,ワ"), ("テスト", "名詞,サ変接続,*,*,*,*,テスト,テスト,テスト"), ("です", "助動詞,*,*,*,特殊・デス,基本形,です,デス,デス"), ("。", "記号,句点,*,*,*,*,。,。,。")]


#: SQL: what the lines made by _mecab_lines say of a token: every length and place has another mixture.
_MECAB_SQL = f"""
w AS (SELECT doc_id, pos, token, length(token) AS k, lower(token) AS low FROM (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM ({_TURNS}))),
named AS (SELECT *, CASE WHEN pos % 11 = 5 THEN 'ん' ELSE token END AS surface, k % 4 = 1 AS short, ['名詞', '助詞', '動詞', '記号', '接続詞'][k % 5 + 1] AS tag,
  CASE WHEN pos % 13 = 6 THEN 'する' WHEN k % 3 = 0 OR contains(token, ',') THEN '*' ELSE low END AS said FROM w),
rooted AS (SELECT *, CASE WHEN short THEN surface WHEN surface = 'ん' THEN 'ない' WHEN said = '*' THEN surface ELSE said END AS root FROM named),
judged AS (SELECT *, root <> 'ない' AND (tag IN ('助詞', '記号', '接続詞') OR (NOT short AND k % 7 = 0) OR root = 'する') AS stop FROM rooted),
sounds AS (SELECT *, CASE WHEN NOT short AND k % 6 <> 2 AND k % 2 = 1 THEN 'PU' WHEN NOT short AND k % 2 = 0 THEN 'ri' ELSE surface END AS sound FROM judged)"""


def _mecab_lines(toks: Column) -> Column:
    """Lines as a MeCab analyzer gives them, made from plain tokens: with stop words of all kinds, unknown roots, missing
    readings and missing fields."""

    def line(token: Column, pos: Column) -> Column:
        k = F.length(token)
        tag = F.get(F.array(*map(F.lit, ("名詞", "助詞", "動詞", "記号", "接続詞"))), k % 5)
        surface, bound = F.when(pos % 11 == 5, "ん").otherwise(token), F.when(pos % 11 == 5, "不変化型").otherwise("*")
        root = F.when(pos % 13 == 6, "する").when((k % 3 == 0) | F.contains(token, F.lit(",")), "*").otherwise(F.lower(token))
        fields = [tag, F.when(k % 7 == 0, "非自立").otherwise("一般"), F.lit("*"), F.lit("*"), bound, F.lit("*"), root, F.when(k % 2 == 0, "ri").otherwise("")]
        spoken = F.when(k % 2 == 1, "PU").otherwise("")
        return F.concat(surface, F.lit("\t"), F.when(k % 4 == 1, tag).when(k % 6 == 2, F.concat_ws(",", *fields)).otherwise(F.concat_ws(",", *fields, spoken)))

    return F.transform(toks, line)


def _turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("doc_id", tokenize(F.col("text")).alias("toks"))


@registered(f"""
WITH {_MECAB_SQL},
spelt AS (SELECT doc_id, pos, stop, sound, surface, root, {PUNCT.format('surface')} AS mark, CASE WHEN stop THEN '~' || tag ELSE tag END AS tag FROM sounds),
texts AS (SELECT doc_id, string_agg(root, ' ' ORDER BY pos) FILTER (NOT stop) AS roots, string_agg(surface, ' ' ORDER BY pos) AS surfaces, string_agg(sound, ' ' ORDER BY pos) AS kana,
  string_agg(CASE WHEN mark THEN surface ELSE root END || '/' || CASE WHEN mark THEN '.' ELSE tag END, ' ' ORDER BY pos) AS triples, bool_and(stop) AS all_stop FROM spelt GROUP BY doc_id)
SELECT t.doc_id, coalesce(roots, surfaces, '') AS normalized, coalesce(kana, '') AS kana, coalesce(triples, '') AS triples, coalesce(all_stop, true) AS all_stop,
  coalesce(surfaces, '') AS unstopped FROM ({_TURNS}) t LEFT JOIN texts USING (doc_id)""")
def records_mecab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A MeCab analyzer's lines, made from the tokens of conversations: parsed, normalised, as kana, as triples."""
    r = F.col("r")
    rows = _turn_tokens(spark, sf_dir).select("doc_id", records.from_mecab(_mecab_lines(F.col("toks"))).alias("r"), records.from_mecab(_mecab_lines(F.col("toks")), stopwords=False).alias("u"))
    triples = F.array_join(F.transform(records.triples(r), lambda t: F.concat(t["stem"], F.lit("/"), t["tag"])), " ")
    every = F.array_join(F.transform(records.content(F.col("u")), lambda x: x["surface"]), " ")
    return rows.select("doc_id", records.normalized(r).alias("normalized"), records.kana_of(r).alias("kana"), triples.alias("triples"), records.all_stop(r).alias("all_stop"), every.alias("unstopped"))


@registered("SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents))")
def freeling_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every text that a FreeLing analyzer is given."""
    dirty = F.concat(F.lit("\n \n"), F.col("text"), F.lit("\n\t\n"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(records.freeling_input(dirty)).alias("pos", "line"))
    return rows.select("doc_id", "pos", "line")


@registered(f"""
WITH p AS (SELECT doc_id, regexp_extract_all(lower(replace(text, chr(10), ' ')), '(?s)(?:.{{1,1000}}\\z|.{{0,999}}[{_BOUNDARY}]|.{{1000}})') AS pieces FROM documents)
SELECT doc_id, CAST(unnest(range(len(pieces))) AS INTEGER) AS pos, unnest(pieces) AS piece FROM p""")
def mecab_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text that a MeCab analyzer is given, of 1,000 characters at most."""
    given = records.mecab_input(F.concat(F.lit("\x01"), F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.string_pieces(given, 1000)).alias("pos", "piece"))


_SETTINGS_SQL = [
    ("Lang", ("en", "es", "it", "pt", "ru", "en")), ("AffixAnalysis", ("yes", "yes", "yes", "yes", "no", "yes")), ("PunctuationDetection", ("yes", "yes", "yes", "yes", "no", "yes")),
    ("DecimalPoint", (".", ",", ",", ",", ".", ".")), ("ThousandPoint", (",", ".", ".", ".", ",", ",")), ("TaggerRetokenize", ("yes", "yes", "yes", "yes", "yes", "no")),
    ("TaggerForceSelect", ("tagger", "tagger", "tagger", "tagger", "tagger", "none")), ("Tagger", ("hmm",) * 6), ("AlwaysFlush", ("yes",) * 6), ("ProbabilityThreshold", ("0.001",) * 6),
]


@registered(f"SELECT * FROM (VALUES {_values([(lang, key, value) for key, row in _SETTINGS_SQL for lang, value in zip(('en', 'es', 'it', 'pt', 'ru', 'cy'), row, strict=True)])}) t(lang, key, value)")
def freeling_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analyzers' configuration files set, read back from the files' lines: the settings that bear on results."""
    lines = [(lang, line) for lang in freeling.LANGUAGES for name, content in freeling.files(lang) if name.endswith(".cfg") for line in content.split("\n")]
    rows = config.settings(spark.createDataFrame(lines, "lang string, value string"), "lang")
    return rows.where(F.col("key").isin(*(key for key, _ in _SETTINGS_SQL)))


#: A stand-in for an analyzer: it answers each line with a record for each word, in either program's format.
_STAND_IN = """
import sys
mecab = sys.argv[1] == "mecab"
for line in sys.stdin:
    for word in line.split():
        print(word + "\\tX,*,*,*,*,*," + word[::-1].replace(",", "") if mecab else word + " " + word + (" DT" if len(word) < 4 else " NN") + " 0.5")
    print("EOS" if mecab else "", flush=True)
"""
_STAND_INS = {
    "mecab": analyzer.Protocol((sys.executable, "-c", _STAND_IN, "mecab"), "EOS"),
    "freeling": analyzer.Protocol((sys.executable, "-c", _STAND_IN, "freeling"), ""),
}
_SPLIT_TURNS = "SELECT conv_id * 1000 + turn AS doc_id, list_filter(regexp_split_to_array({}, '[ \n\t\r]+'), lambda x: x <> '') AS ws FROM conversations"


@registered(f"SELECT doc_id, array_to_string(list_transform(ws, lambda x: x || '/' || replace(reverse(x), ',', '')), ' ') AS said FROM ({_SPLIT_TURNS.format('lower(text)')})")
def mecab_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through a process that speaks MeCab's protocol."""
    rows = analyzer.analyzed_by_mecab(_turns(spark, sf_dir), _STAND_INS["mecab"]).select("doc_id", records.from_mecab(F.col("lines")).alias("r"))
    return rows.select("doc_id", F.array_join(F.transform("r", lambda x: F.concat(x["surface"], F.lit("/"), x["root"])), " ").alias("said"))


@registered(f"""
SELECT doc_id, array_to_string(CASE WHEN len(list_filter(ws, lambda x: length(x) >= 4)) > 0 THEN list_transform(list_filter(ws, lambda x: length(x) >= 4), lambda x: lower(x)) ELSE ws END, ' ') AS normalized
FROM ({_SPLIT_TURNS.format('text')})""")
def freeling_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through a process that speaks FreeLing's protocol, as a language chosen by a column."""
    docs = _turns(spark, sf_dir).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "es").otherwise("pt"))
    chosen = {lang: languages.by_freeling(lang, _STAND_INS["freeling"]) for lang in ("es", "pt")}
    return languages.apply(docs, chosen, "normalize").select("doc_id", F.col("normalize").alias("normalized"))


@registered(f"SELECT doc_id, array_to_string(list_transform(ws, lambda x: lower(x) || '|a'), ' ') AS lemmas FROM ({_SPLIT_TURNS.format('text')})")
def remote_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of a remote analyzer's stand-in, each of which names its source."""
    return analyzer.remote_lemmas(_turns(spark, sf_dir), lambda t: [f"{w.lower()}|a|SOURCE" for w in t.split()]).select("doc_id", "lemmas")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # as a pattern, since a table may be one file or a folder of them
    return stream_texts(spark, f"{path[:-1]}[t]", spark.read.parquet(path).schema)


@registered(f"SELECT doc_id, CAST(unnest(range(len(toks))) AS INTEGER) AS pos, unnest(toks) AS token FROM ({_TURNS})")
def stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of conversations that come as a stream, written exactly once."""
    turns = _stream(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.posexplode(tokenize(F.col("text"))).alias("pos", "token"))
    return streaming.written(turns, "stream-tokens")


@registered("""
WITH w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, lower(event_type) AS word, count(*) AS n FROM events GROUP BY ALL)
SELECT start, start + INTERVAL '5 minutes' AS "end", word, n FROM w WHERE start + INTERVAL '5 minutes' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of an event stream in windows of five minutes: those that the watermark has closed."""
    events = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    counts = streaming.windowed_counts(events, F.col("ts"))
    return streaming.written(counts.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), "stream-counts")


def _piece_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents as files in an order that mixes texts and places, read as a stream."""
    cut = _table(spark, sf_dir, "documents").select("doc_id", text.string_pieces(F.col("text"), PIECE).alias("ps"))
    rows = cut.select(F.col("doc_id").alias("key"), F.size("ps").alias("pieces"), F.posexplode("ps").alias("at", "piece"))
    rows = rows.repartition(6, F.xxhash64("key", "at", F.lit("mixed")))
    rows = rows.withColumn("time", (F.lit(1_700_000_000) + F.pmod(F.xxhash64("key", "at"), F.lit(300))).cast("timestamp"))
    path = streaming.shared_folder(spark, "pieces")
    rows.write.option("compression", "zstd").parquet(path)
    return stream_texts(spark, path, rows.schema, files_at_once=2)


@registered("SELECT doc_id AS key, text, CAST(len(pieces) AS INTEGER) AS n_pieces, true AS whole FROM (SELECT doc_id, text, regexp_extract_all(text, '(?s)(?:.{1,%d}\\z|.{0,%d}[%s]|.{%d})') AS pieces FROM documents) WHERE len(pieces) > 0" % (PIECE, PIECE - 1, _BOUNDARY, PIECE))
def stream_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents, joined again from a stream of their pieces that comes in mixed order."""
    return streaming.written(streaming.reassembled(_piece_stream(spark, sf_dir)), "reassembled")


@registered(f"WITH {_RANKED} SELECT rank, freq, word FROM listed WHERE rank <= 5000")
def freq_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequency lists of all languages, written as files of lists and read again; their first 5,000 places, which the source
    itself picks out."""
    freqlist.register(spark)
    path = streaming.shared_folder(spark, "lists")
    listed = _lists(spark, sf_dir).select("rank", "freq", "word")
    listed.write.format("freqlist").mode("append").option("path", path.removeprefix("file://")).save()
    return spark.read.format("freqlist").option("path", path.removeprefix("file://")).load().where("rank <= 5000")
