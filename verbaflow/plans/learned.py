"""Registered queries over what is learned from the tables' own texts, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frequency
from ..functions.lexicon import DETACHMENTS, Lexicon
from ..functions.tokenize import tokenize
from ..operators import guess, hmm, identify, induction, stem
from ..operators import sentences as sents
from .registry import _BASELINE, _POS, _RANKED, _TURNS, TOKENS, _stem_ctes, _table, _turns, _values, _words, lists_of, registered, word_counts

_BLANK = "[\\t-\\r ]"
#: SQL: the words of all documents with what stands before them, and their counts.
_WORDS = f"""
d AS (SELECT row_number() OVER () AS r, doc_id, lang, text, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT lang, regexp_replace(word, '{sents.AROUND}', '', 'g') AS core, prior FROM (SELECT lang, unnest(ws) AS word, unnest(list_prepend(NULL, ws)) AS prior FROM d) WHERE word IS NOT NULL),
words AS MATERIALIZED (
  SELECT lang, lower(regexp_replace(core, '\\.$', '')) AS form, count(*) AS n, count(*) FILTER (ends_with(core, '.')) AS n_period, count(*) FILTER (regexp_matches(core, '^\\p{{Ll}}')) AS n_lower,
    count(*) FILTER (regexp_matches(core, '^\\p{{Lu}}') AND NOT regexp_matches(prior, '{sents.ENDED.replace("'", "''")}')) AS n_upper_inside
  FROM t WHERE core <> '' GROUP BY ALL
),
known AS MATERIALIZED (
  SELECT lang, form, n, n_period, 2 * (n_period * ln(0.99) + (n - n_period) * ln(1 - 0.99) - n_period * ln(p) - (n - n_period) * ln(1 + 1e-8 - p)) * exp(-letters) * (inside + 1) * pow(letters, -(n - n_period)) AS score
  FROM (SELECT *, length(regexp_replace(form, '[^.]+', '', 'g')) AS inside, CAST(length(form) - length(regexp_replace(form, '[^.]+', '', 'g')) AS DOUBLE) AS letters FROM words)
  JOIN (SELECT lang, sum(n_period) / sum(n) AS p FROM words GROUP BY lang) USING (lang) WHERE n_period > 0 AND regexp_matches(form, '\\p{{L}}')
)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


@registered(f"WITH {_WORDS} SELECT lang, form, n, n_period, n_lower, n_upper_inside FROM words")
def word_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of a language stands with a period, in lower case, and with a capital inside of sentences."""
    return sents.word_statistics(_documents(spark, sf_dir))


@registered(f"WITH {_WORDS} SELECT lang, form, n, n_period, CAST(round(score * 100) AS BIGINT) AS score FROM known WHERE score >= {sents.LEAST_SCORE}")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose periods end no sentence, as the documents of each language show; the score in hundredths."""
    found = sents.abbreviations(hmm.kept(sents.word_statistics(_documents(spark, sf_dir)), "words"))
    return found.withColumn("score", F.round(F.col("score") * 100).cast("long"))


def _core(word: str) -> str:
    return f"regexp_replace({word}, '{sents.AROUND}', '', 'g')"


@registered(f"""
WITH {_WORDS},
cut AS (SELECT r, doc_id, lang, string_split(regexp_replace(replace(text, chr(1), ''), '{sents.CANDIDATE.replace("'", "''")}', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1)) AS ps FROM d),
parts AS (SELECT r, doc_id, lang, unnest(range(len(ps))) AS i, unnest(ps) AS p, unnest(list_append(ps[2:], NULL)) AS after FROM cut),
ends AS (SELECT r, lang, i, {_core(f"regexp_extract(p, '([^\\t-\\r ]+){_BLANK}*$', 1)")} AS core, {_core(f"regexp_extract(after, '^{_BLANK}*([^\\t-\\r ]+)', 1)")} AS follows FROM parts WHERE after IS NOT NULL),
wrong AS (
  SELECT e.r, e.i FROM (SELECT *, lower(regexp_replace(core, '\\.$', '')) AS form, lower(regexp_replace(follows, '\\.$', '')) AS next FROM ends WHERE ends_with(core, '.')) e
  LEFT JOIN (SELECT lang, form FROM known WHERE score >= {sents.LEAST_SCORE}) k ON k.lang = e.lang AND k.form = e.form
  WHERE (k.form IS NOT NULL OR regexp_matches(e.core, '^\\p{{Lu}}\\.$')) AND NOT EXISTS (SELECT 1 FROM words w WHERE w.lang = e.lang AND w.form = e.next AND w.n_lower > 0 AND w.n_upper_inside = 0)
),
runs AS (SELECT p.r, p.doc_id, p.i, p.p, sum(CASE WHEN p.i = 0 OR f.i IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS UNBOUNDED PRECEDING) AS run FROM parts p LEFT JOIN wrong f ON f.r = p.r AND f.i = p.i - 1),
found AS (SELECT r, doc_id, run, regexp_replace(string_agg(p, '' ORDER BY i), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS sentence FROM runs GROUP BY r, doc_id, run)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY r ORDER BY run) - 1 AS INTEGER) AS pos, sentence FROM found WHERE sentence <> ''""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document, by the abbreviations of its language."""
    rows = sents.sentences(_documents(spark, sf_dir), "doc_id")
    return rows.select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))


_K = len(hmm.TAGS)
_SHAPE = "CASE WHEN regexp_matches(token, '^[\\p{N}.,]*\\p{N}[\\p{N}.,]*$') THEN 'number' WHEN NOT regexp_matches(token, '[\\p{L}\\p{N}]') THEN 'mark' WHEN regexp_matches(token, '^\\p{Lu}') THEN 'capital' " + " ".join(f"WHEN ends_with(lower(token), '{e}') THEN '-{e}'" for e in hmm.ENDINGS) + " ELSE 'other' END"
#: SQL: the words of the turns with their symbols, and the scores of the model that counts under the plain tagger make.
_MODEL = f"""
turns AS ({_TURNS}), tags(tag, k) AS (VALUES {_values([(t, i) for i, t in enumerate(hmm.TAGS)])}),
flat AS MATERIALIZED (SELECT doc_id, pos, token, pos // {hmm.MOST_TOKENS} AS part, pos % {hmm.MOST_TOKENS} AS i FROM (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM turns)),
frequent AS MATERIALIZED (SELECT lower(token) AS low FROM flat GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {hmm.FREQUENT}),
said AS MATERIALIZED (
  SELECT f.doc_id, f.part, f.i, f.pos, f.token, CASE WHEN q.low IS NOT NULL THEN '=' || q.low ELSE {_SHAPE} END AS symbol, coalesce(t.k, {hmm.TAGS.index(hmm.OTHER_TAG)}) AS k
  FROM (SELECT *, {_BASELINE} AS plain FROM flat) f LEFT JOIN frequent q ON q.low = lower(f.token) LEFT JOIN tags t ON t.tag = f.plain
),
syms AS (SELECT '=' || low AS symbol FROM frequent UNION ALL SELECT * FROM (VALUES {_values([(x,) for x in hmm.SHAPES])})),
n1 AS (SELECT k, count(*) AS n FROM said WHERE i = 0 GROUP BY k),
n2 AS (SELECT a, b, count(*) AS n FROM (SELECT k AS b, lag(k) OVER (PARTITION BY doc_id, part ORDER BY i) AS a FROM said) WHERE a IS NOT NULL GROUP BY a, b),
n3 AS (SELECT k, symbol, count(*) AS n FROM said GROUP BY k, symbol),
starts AS MATERIALIZED (SELECT t.k, CAST(floor(1000 * ln((coalesce(n, 0) + 1) / ((SELECT sum(n) FROM n1) + {_K})) + 0.5) AS INTEGER) AS s FROM tags t LEFT JOIN n1 USING (k)),
moves AS MATERIALIZED (SELECT x.k AS a, y.k AS b, CAST(floor(1000 * ln((coalesce(n, 0) + 1) / (coalesce(sum(n) OVER (PARTITION BY x.k), 0) + {_K})) + 0.5) AS INTEGER) AS s FROM tags x CROSS JOIN tags y LEFT JOIN n2 ON n2.a = x.k AND n2.b = y.k),
emits AS MATERIALIZED (SELECT t.k, y.symbol, CAST(floor(1000 * ln((coalesce(n, 0) + 1) / (coalesce(sum(n) OVER (PARTITION BY t.k), 0) + (SELECT count(*) FROM syms))) + 0.5) AS INTEGER) AS s FROM tags t CROSS JOIN syms y LEFT JOIN n3 ON n3.k = t.k AND n3.symbol = y.symbol),
paths AS (
  SELECT o.doc_id, o.part, 0 AS i, t.k, t.s + e.s AS score, [t.k] AS path FROM said o JOIN starts t ON o.i = 0 JOIN emits e ON e.k = t.k AND e.symbol = o.symbol
  UNION ALL
  SELECT p.doc_id, p.part, p.i + 1, m.b, max(p.score + m.s) + any_value(e.s), list_append(arg_max(p.path, (p.score + m.s) * {_K} - p.k), m.b)
  FROM paths p JOIN said o ON o.doc_id = p.doc_id AND o.part = p.part AND o.i = p.i + 1 JOIN moves m ON m.a = p.k JOIN emits e ON e.k = m.b AND e.symbol = o.symbol GROUP BY p.doc_id, p.part, p.i, m.b
),
ends AS (SELECT doc_id, part, max(i) AS i FROM paths GROUP BY doc_id, part),
walks AS (SELECT p.doc_id, p.part, arg_max(p.path, p.score * {_K} - p.k) AS path FROM paths p JOIN ends e ON e.doc_id = p.doc_id AND e.part = p.part AND e.i = p.i GROUP BY p.doc_id, p.part),
decoded AS MATERIALIZED (SELECT o.doc_id, o.pos, o.token, t.tag FROM said o JOIN walks b ON b.doc_id = o.doc_id AND b.part = o.part JOIN tags t ON t.k = b.path[o.i + 1])"""


def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, hmm.Hmm]:
    rows = hmm.kept(hmm.sequences(_turns(spark, sf_dir)), "sequences")
    return rows, hmm.counted(rows, hmm.frequent_words(rows.select(F.explode("tokens").alias("token"))))


@registered(f"""
WITH RECURSIVE {_MODEL}, spoken AS (SELECT *, {_POS.format(tag="tag")} AS sort FROM (SELECT *, lower(token) AS low FROM decoded)), {_stem_ctes("SELECT low, sort AS pos FROM spoken")}
SELECT f.doc_id, CAST(f.pos AS INTEGER) AS pos, s.stem, f.tag, f.token FROM spoken f JOIN stemmed s ON s.low = f.low AND s.pos IS NOT DISTINCT FROM f.sort""")
def tag_hmm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations tagged by the hidden Markov model of the counts under the plain tagger, with stems."""
    _, model = _counted(spark, sf_dir)
    return hmm.tag_and_stem(_turns(spark, sf_dir), model, Lexicon.seed(spark))


#: Rounds of expectation-maximisation of the registered query.
ROUNDS = 4


@registered()
def tag_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after ROUNDS rounds of expectation-maximisation over all conversations: iterative, so without SQL."""
    rows, model = _counted(spark, sf_dir)
    model, _ = hmm.fitted(hmm.kept(hmm.symbol_ids(rows, model.frequent).select("symbols"), "symbols"), model, ROUNDS)
    return hmm.tag_and_stem(_turns(spark, sf_dir), model, Lexicon.seed(spark))


#: SQL: the words of each language, their splits, signatures and lemmas.
_LEXICON = f"""
types AS MATERIALIZED (SELECT DISTINCT lang, lower(token) AS word FROM (SELECT lang, unnest(toks) AS token FROM ({TOKENS})) WHERE regexp_matches(lower(token), '^\\p{{L}}+$')),
cuts AS MATERIALIZED (SELECT lang, left(word, length(word) - k) AS stem, right(word, k) AS suffix FROM (SELECT lang, word, unnest(range(least({induction.MOST_SUFFIX}, length(word) - {induction.LEAST_STEM}) + 1)) AS k FROM types)),
common AS (SELECT lang, suffix FROM (SELECT lang, suffix, count(*) AS n FROM cuts WHERE suffix <> '' GROUP BY lang, suffix) JOIN (SELECT lang, count(*) AS size FROM types GROUP BY lang) USING (lang) WHERE n >= size * CAST({induction.LEAST_SHARE} AS DOUBLE)),
signed AS MATERIALIZED (
  SELECT lang, stem, array_to_string(list_sort(list(DISTINCT CASE WHEN suffix = '' THEN '{induction.NONE}' ELSE suffix END)), '.') AS signature
  FROM cuts c WHERE suffix = '' OR EXISTS (SELECT 1 FROM common m WHERE m.lang = c.lang AND m.suffix = c.suffix) GROUP BY lang, stem HAVING count(*) > 1
),
able AS (SELECT lang, signature, count(*) AS n_stems FROM signed GROUP BY lang, signature HAVING count(*) >= {induction.LEAST_STEMS}),
good AS (SELECT s.lang, s.stem FROM signed s SEMI JOIN able a USING (lang, signature)),
detach(p, old, new) AS (VALUES {_values(DETACHMENTS)}),
ways AS (SELECT t.lang, d.p AS pos, d.old, left(t.word, length(t.word) - length(d.old)) AS stem, left(t.word, length(t.word) - length(d.old)) || d.new AS form FROM types t JOIN detach d ON ends_with(t.word, d.old)),
induced AS MATERIALIZED (
  SELECT w.lang, w.form, w.pos, count(DISTINCT w.old) AS n_forms FROM ways w SEMI JOIN good g USING (lang, stem) SEMI JOIN (SELECT lang, word AS form FROM types) x USING (lang, form)
  GROUP BY w.lang, w.form, w.pos HAVING count(DISTINCT w.old) >= CASE w.pos {" ".join(f"WHEN '{p}' THEN {n}" for p, n in induction.LEAST_FORMS.items())} END
)"""


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of each language, kept: they are read several times."""
    return hmm.kept(induction.word_types(_words(spark, sf_dir, "lang")), "types")


def _english(types: DataFrame, spark: SparkSession) -> Lexicon:
    """The seed with the lemmas that English words show; they are kept, so that Spark knows their size."""
    return induction.lexicon(hmm.kept(induction.induced(types).where("lang = 'en'"), "lemmas"), Lexicon.seed(spark))


@registered(f"WITH {_LEXICON} SELECT lang, signature, n_stems FROM able")
def suffix_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The productive sets of endings of each language, and how many stems have them."""
    return induction.productive(induction.signatures(_types(spark, sf_dir)))


@registered(f"WITH {_LEXICON} SELECT lang, form, pos, n_forms FROM induced")
def lexicon_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the documents of a language show to be lemmas."""
    return induction.induced(_types(spark, sf_dir))


_ENGLISH = "SELECT form, pos AS p FROM induced WHERE lang = 'en'"


@registered(f"""
WITH RECURSIVE {_LEXICON}, {_stem_ctes(f"SELECT low, {_POS.format(tag='CAST(NULL AS VARCHAR)')} AS pos FROM (SELECT DISTINCT word AS low FROM types)", more=_ENGLISH)}
SELECT low AS word, stem FROM stemmed""")
def stem_words_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every word, by the lemmas that the English documents show beside those of the seed."""
    types = _types(spark, sf_dir)
    lexicon = _english(types, spark)
    return stem.stems(types.select("word").distinct().withColumn("tag", F.lit(None).cast("string")), lexicon).select("word", "stem")


@registered(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, doc_id % 4 = 2 AS held_out, string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g'), ' ') || ' ', '') AS cs FROM documents),
grams AS MATERIALIZED (SELECT r, lang, held_out, unnest(list_transform(range(1, len(cs) - 1), lambda i: cs[i] || cs[i + 1] || cs[i + 2])) AS gram FROM d),
counts AS MATERIALIZED (SELECT lang, gram, count(*) AS n FROM grams WHERE NOT held_out GROUP BY lang, gram),
kept AS MATERIALIZED (SELECT gram FROM counts GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {identify.MOST_GRAMS}),
below AS (SELECT lang, sum(n) + (SELECT count(*) FROM kept) AS below FROM counts SEMI JOIN kept USING (gram) GROUP BY lang),
scores AS MATERIALIZED (SELECT k.gram, b.lang, CAST(floor(1000 * ln((coalesce(c.n, 0) + 1) / CAST(b.below AS DOUBLE)) + 0.5) AS INTEGER) AS score FROM kept k CROSS JOIN below b LEFT JOIN counts c ON c.gram = k.gram AND c.lang = b.lang),
unseen AS (SELECT lang, CAST(floor(1000 * ln(1 / CAST(below AS DOUBLE)) + 0.5) AS INTEGER) AS score FROM below),
said AS MATERIALIZED (SELECT r, gram, count(*) AS n FROM grams GROUP BY r, gram),
sums AS (SELECT s.r, u.lang, sum(s.n) AS n_grams, sum(s.n * coalesce(x.score, u.score)) AS score FROM said s CROSS JOIN unseen u LEFT JOIN scores x ON x.gram = s.gram AND x.lang = u.lang GROUP BY s.r, u.lang),
best AS (SELECT r, any_value(n_grams) AS n_grams, first(lang ORDER BY score DESC, lang) AS guessed, max(score) AS score FROM sums GROUP BY r)
SELECT d.doc_id, d.lang, d.held_out, CAST(coalesce(b.n_grams, 0) AS BIGINT) AS n_grams, b.guessed, CAST(b.score AS BIGINT) AS score FROM d LEFT JOIN best b USING (r)""")
def identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of three quarters of them; the others are held out."""
    docs = _documents(spark, sf_dir).withColumn("held_out", F.col("doc_id") % 4 == 2)
    return identify.identified(docs, identify.trained(docs.where("NOT held_out")), "doc_id", "lang", "held_out")


def _step(k: int) -> str:
    """SQL: the tags' probabilities by endings of up to k letters."""
    return f"""
p{k} AS (
  SELECT p.word, p.k, CASE WHEN s.total IS NULL OR length(p.word) < {k} THEN p.p ELSE (coalesce(c.n, 0) / s.total + weight * p.p) / (1 + weight) END AS p
  FROM p{k - 1} p CROSS JOIN weights LEFT JOIN totals s ON s.ending = right(p.word, {k}) AND s.size = {k} LEFT JOIN endings c ON c.ending = right(p.word, {k}) AND c.size = {k} AND c.k = p.k
),"""


@registered(f"""
WITH turns AS ({_TURNS}), tags(tag, k) AS (VALUES {_values([(t, i) for i, t in enumerate(hmm.TAGS)])}),
said AS (SELECT lower(token) AS word, tag, count(*) AS n FROM (SELECT token, {_BASELINE} AS tag FROM (SELECT unnest(toks) AS token FROM turns)) WHERE regexp_matches(token, '^\\p{{L}}+$') GROUP BY ALL),
taught AS MATERIALIZED (SELECT word, t.k, sum(n) AS n FROM said JOIN tags t USING (tag) WHERE left(md5(word), 1) NOT IN ('0', '1', '2', '3') GROUP BY ALL),
endings AS MATERIALIZED (SELECT right(word, size) AS ending, size, k, sum(n) AS n FROM (SELECT word, k, n, unnest(range(least({guess.LONGEST}, length(word)) + 1)) AS size FROM taught) GROUP BY ALL),
totals AS MATERIALIZED (SELECT ending, size, sum(n) AS total FROM endings GROUP BY ending, size),
shares AS (SELECT t.k, coalesce(e.n, 0) / (SELECT total FROM totals WHERE size = 0) AS p FROM tags t LEFT JOIN endings e ON e.size = 0 AND e.k = t.k),
weights AS (SELECT sum((p - 1 / {_K}) * (p - 1 / {_K})) / {_K - 1} AS weight FROM shares),
asked AS (SELECT word, first(tag ORDER BY n DESC, tag) AS actual FROM said WHERE left(md5(word), 1) IN ('0', '1', '2', '3') GROUP BY word),
p0 AS (SELECT word, k, p FROM asked CROSS JOIN shares),{"".join(_step(k) for k in range(1, guess.LONGEST + 1))}
best AS (SELECT word, count(*) AS n_tags, first(k ORDER BY parts DESC, k) AS k, max(parts) AS parts FROM (SELECT word, k, CAST(round(p * {guess.PARTS}) AS BIGINT) AS parts FROM p{guess.LONGEST}) WHERE parts >= {int(guess.LEAST * guess.PARTS)} GROUP BY word)
SELECT a.word, a.actual, t.tag AS guessed, CAST(round(b.parts / 1000) AS BIGINT) AS millionths, CAST(b.n_tags AS INTEGER) AS n_tags FROM asked a JOIN best b USING (word) JOIN tags t ON t.k = b.k""")
def guess_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of a quarter of the conversations' words, by the endings of the others; and the tag that they have there most often."""
    tokens = _turns(spark, sf_dir).select(F.explode(tokenize(F.col("text"))).alias("token")).where(F.col("token").rlike(r"^\p{L}+$"))
    said = tokens.groupBy(F.lower("token").alias("word"), stem.baseline_tag(F.col("token")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    held = F.left(F.md5("word"), F.lit(1)).isin("0", "1", "2", "3")
    actual = said.where(held).groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("less"), "tag")).alias("m")).select("word", F.col("m.tag").alias("actual"))
    rows = guess.guessed(actual, guess.learned(said.where(~held)))
    best = F.get("guesses", F.lit(0))
    return rows.select("word", "actual", best["tag"].alias("guessed"), F.round(best["parts"] / 1000).cast("long").alias("millionths"), F.size("guesses").alias("n_tags"))


@registered(f"""
WITH RECURSIVE {_LEXICON}, {_RANKED}, {_stem_ctes(f"SELECT low, {_POS.format(tag='CAST(NULL AS VARCHAR)')} AS pos FROM (SELECT DISTINCT lower(word) AS low FROM listed)", more=_ENGLISH)}
SELECT l.lang, s.stem AS word, sum(l.freq) AS freq FROM listed l JOIN stemmed s ON s.low = lower(l.word) GROUP BY l.lang, s.stem""")
def freq_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of all languages by stems, each word of all lists together asked for once."""
    counts = word_counts(spark, sf_dir)
    lexicon = _english(hmm.kept(induction.word_types(counts.select("lang", F.col("word").alias("token"))), "types"), spark)

    def analyze(words: DataFrame) -> DataFrame:
        return stem.stems(words.withColumn("tag", F.lit(None).cast("string")), lexicon).select("word", F.col("stem").alias("lemma"))

    return frequency.translated(hmm.kept(lists_of(counts), "lists"), analyze, "lang")
