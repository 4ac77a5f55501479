"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Base candidates are the matches of three patterns. Further candidates are long mixed tokens anywhere in a text. Every
candidate's value is hashed, and over the whole corpus the distinct repositories and owners of each hash are counted:
a value that many owners hold is a copied example, one that few hold looks live. Base spans are all kept and bear the
verdict; of the further candidates the live ones become spans of their own, beside them.

Match positions come from splitting the text by the same pattern: the gaps and the matches alternate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table, unused

#: Kinds in the order that breaks ties, with their patterns, the group whose length counts, and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: [0-9a-f]+ of 16 or more; runs are maximal either way.
HEX = r"[0-9a-f]{16,}"
#: Further candidates: runs of token characters of 20 or more, which must hold a digit, a lower and an upper case letter.
MIXED = r"[A-Za-z0-9+/_-]{20,}"
ORDER = {"assign": 0, "access": 1, "hex": 2, "live": 3}
#: A value held by more owners than this is a copied example.
OWNERS = 2
#: The same for repositories.
REPOSITORIES = 4
MASK = "[SECRET]"
#: Spans that are broadcast to the documents, at most (they have no texts, so a bounded size); beyond, the join shuffles.
FEW_SPANS = 100_000
SPAN = "array<struct<start: int, rank: int, kind: string, end: int, value: string>>"


def matches(text: Column, kind: str, pattern: str, least: int, group: int = 0, also: Column | None = None) -> Column:
    """array<struct<start, rank, kind, end, value>> of the kind's matches, in code points; value is the counted group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def grow(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["found"])
        one = F.struct(start.alias("start"), F.lit(ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"))
        keep = F.when(F.length(pair["value"]) >= least, F.array(one)).otherwise(F.array().cast(SPAN))
        return F.struct(end.alias("at"), F.concat(state["out"], keep).alias("out"))

    pairs = F.zip_with(F.arrays_zip(found.alias("found"), values.alias("value")), gaps, lambda m, g: F.struct(m["found"].alias("found"), m["value"].alias("value"), g.alias("gap")))
    pairs = F.filter(pairs, lambda p: p["found"].isNotNull())  # the gap after the last match
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), grow, lambda s: s["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """All base spans and, of kind live, the further candidates; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    mixed = F.filter(matches(text, "live", MIXED, 20), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]"))
    return F.concat(matches(text, "assign", ASSIGN, 12, 2), matches(text, "access", ACCESS, 18), matches(text, "hex", HEX, 16), mixed)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates(digest, owner, repository) to digest, n_owners, n_repositories; each phase combines on the map side."""
    return candidates.groupBy("digest").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))


def scanned(docs: DataFrame, owner: Column, repository: Column, into: str) -> DataFrame:
    """docs with a further column, called `into`: all candidates of the text in order, each with n_owners and n_repositories
    of its value.

    The candidates are written once, so that texts are searched once, and come back by the row's own digest. Rows that are
    equal in doc_id and text share one digest and so one result; a null doc_id is an id like any other. A null owner or
    repository counts as one more of them.
    """
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    key = F.unhex(F.sha2(F.concat(text, F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))).cast("binary"), 256))
    found = docs.select(key.alias("key"), F.coalesce(owner, F.lit("\x00")).alias("owner"), F.coalesce(repository, F.lit("\x00")).alias("repository"), candidates(F.col("text")).alias("every"))
    held = found.where(F.size("every") > 0).select("key", "owner", "repository", F.explode("every").alias("m"))
    held = materialise(held.withColumns({"digest": F.unhex(F.sha2(F.col("m.value").cast("binary"), 256)), "m": F.col("m").dropFields("value")}), "secret-candidates")
    counts = materialise(ownership(held), "secret-ownership")  # plain tables on both sides, so that a hot value is split
    told = held.join(counts, "digest").select("key", F.struct("m.*", "n_owners", "n_repositories").alias("m"))
    spans = materialise(told.groupBy("key").agg(F.array_sort(F.collect_set("m")).alias("spans")), "secret-spans")
    few = held.count() <= FEW_SPANS
    discard(held, counts)
    own = unused(docs, "__key")
    spans = spans.select(F.col("key").alias(own), F.col("spans").alias(into))
    rows = docs.withColumn(own, key).join(F.broadcast(spans) if few else spans, own, "left")
    return rows.withColumn(into, F.coalesce(F.col(into), F.array().cast(spans.schema[into].dataType))).drop(own)


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "live")


def live_of(spans: Column, owners: int, repositories: int) -> Column:
    """The further candidates whose values few hold."""
    return F.filter(spans, lambda s: (s["kind"] == "live") & (s["n_owners"] <= owners) & (s["n_repositories"] <= repositories))


def secret_spans(docs: DataFrame, owner: Column, repository: Column, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """docs(doc_id, text and what owner and repository name) to doc_id, n_assign, n_access, n_hex, base_sha256, spans, and
    for each span of spans, in its order and parted by commas, n_owners and n_repositories of its value and the verdicts
    (live where both are within the limits, else copied).

    A null text is scanned as an empty one: no spans, and the digest of the empty string. Repeated rows are kept, an
    empty table gives no rows, other columns are ignored. A live token that lies inside a base span isn't told twice. A
    very long text is searched whole.
    """
    rows = scanned(docs.select("doc_id", "text", owner.alias("__owner"), repository.alias("__repository")), F.col("__owner"), F.col("__repository"), "__spans")
    rows = rows.select("doc_id", base_of(F.col("__spans")).alias("base"), live_of(F.col("__spans"), owners, repositories).alias("live"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    fresh = F.filter("live", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    spans = F.array_sort(F.concat("base", fresh))
    each = lambda f, name: F.array_join(F.transform(spans, f), ",").alias(name)
    verdict = lambda s: F.when((s["n_owners"] <= owners) & (s["n_repositories"] <= repositories), "live").otherwise("copied")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans"),
        each(lambda s: s["n_owners"].cast("string"), "n_owners"), each(lambda s: s["n_repositories"].cast("string"), "n_repositories"), each(verdict, "verdicts"),
    )


def redacted(docs: DataFrame, owner: Column, repository: Column, owners: int = OWNERS, repositories: int = REPOSITORIES, mask: str = MASK) -> DataFrame:
    """docs with every span of text replaced by mask (overlapping spans by one); n_chars, where there is one, follows.

    Null and empty texts, and ones without spans, stay as they are; repeated rows and null ids are kept, an empty table
    gives no rows, and other columns pass through, whatever they are called.
    """
    into = unused(docs, "__spans")
    rows = scanned(docs, owner, repository, into)
    spans = F.array_sort(F.concat(base_of(F.col(into)), live_of(F.col(into), owners, repositories)))

    def cut(state: Column, span: Column) -> Column:
        new = span["start"] >= state["at"]
        kept = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(new, F.concat(state["out"], kept, F.lit(mask))).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    text = F.when(F.size(spans) > 0, done).otherwise(F.col("text"))
    out = rows.withColumn("text", text)  # on its own: beside it, an expression might be given the new text
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*docs.columns)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no repository: a source is an owner, its documents of one language are a repository."""
    docs = table(spark, sf_dir, "documents")
    return secret_spans(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN_SQL = _KEYWORD + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found_sql(kind: str, pattern: str, group: int) -> str:
    return f"SELECT n, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d"


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
raw AS ({_found_sql("assign", _ASSIGN_SQL, 2)} UNION ALL {_found_sql("access", ACCESS, 0)} UNION ALL {_found_sql("hex", HEX, 0)} UNION ALL {_found_sql("live", MIXED, 0)}),
each AS (SELECT n, kind, g, m, unnest(m) AS found, unnest(v) AS val, unnest(range(len(m))) AS i FROM raw WHERE len(m) > 0),
spans AS (SELECT n, kind, val, list_sum(list_transform(g[1 : i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i], lambda x: length(x))), 0) AS first, length(found) AS size FROM each
          WHERE length(val) >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 WHEN 'hex' THEN 16 ELSE 20 END),
base AS (SELECT * FROM spans WHERE kind <> 'live'),
mixed AS (SELECT * FROM spans WHERE kind = 'live' AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')),
owned AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repositories
          FROM (SELECT * FROM base UNION ALL SELECT * FROM mixed) JOIN d USING (n) GROUP BY val),
live AS (SELECT mixed.* FROM mixed JOIN owned USING (val) WHERE owners <= {OWNERS} AND repositories <= {REPOSITORIES}
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.n = mixed.n AND b.first <= mixed.first AND mixed.first + mixed.size <= b.first + b.size)),
every AS (SELECT *, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END AS place FROM (SELECT * FROM base UNION ALL SELECT n, kind, val, first, size FROM live) JOIN owned USING (val)),
told AS (SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
           string_agg(kind || ':' || first || ':' || (first + size), ',' ORDER BY first, place) FILTER (kind <> 'live') AS own, string_agg(kind || ':' || first || ':' || (first + size), ',' ORDER BY first, place) AS all_spans,
           string_agg(CAST(owners AS VARCHAR), ',' ORDER BY first, place) AS o, string_agg(CAST(repositories AS VARCHAR), ',' ORDER BY first, place) AS r,
           string_agg(CASE WHEN owners <= {OWNERS} AND repositories <= {REPOSITORIES} THEN 'live' ELSE 'copied' END, ',' ORDER BY first, place) AS v
         FROM every GROUP BY n)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(all_spans, '') AS spans,
       coalesce(o, '') AS n_owners, coalesce(r, '') AS n_repositories, coalesce(v, '') AS verdicts FROM d LEFT JOIN told USING (n)
"""
