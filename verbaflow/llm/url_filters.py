"""URL filters by a sort-merge range join.

A host is written with its labels reversed, each ended by END, so that a rule's host and all its subdomains are one
interval of keys: com.END.example.END. covers every key that starts so. URLs and rules are cut into ranges at
quantiles of the URLs' keys; a rule goes to each range its interval meets, and inside a range one sorted sweep keeps a
stack of the rules whose intervals are open at the current URL: for each open host a table of its path prefixes, which are
intervals of paths. A URL's path is looked up in it by the lengths that prefixes have there, the longest first, so that
the work follows the number of different lengths, not of rules. Equal keys may span many ranges: their URLs are dealt
over those by a hash, and the rules go to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

END, LAST = "\x01", "\U0010ffff"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Verdict of a URL that no rule fits.
DEFAULT = "allow"
#: URL keys that are drawn for the cuts: so many for each range.
DRAWN = 16
#: Cuts that are looked through at once for a key's range.
STEP = 64


def host_of(url: Column) -> Column:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END))


class Paths:
    """The rules of one host: path prefixes, each with its greatest verdict, and their lengths, the longest first."""

    def __init__(self, host: str):
        self.host, self.verdicts, self.lengths = host, {}, []

    def add(self, path: str, verdict: str) -> None:
        self.verdicts[path] = max(verdict, self.verdicts.get(path, ""))
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> tuple | None:
        """The longest rule whose path begins this one: what ranks it, its text and its verdict."""
        for n in self.lengths:
            if n <= len(path) and (verdict := self.verdicts.get(path[:n])) is not None:
                return len(self.host) + n, len(self.host), self.host + path[:n], verdict
        return None


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key, kind): rules (kind 0) come before the URLs (kind 1) with the same key."""
    part, stack = None, []  # the stack: (key, Paths) of open hosts, outermost first
    for batch in batches:
        cols = batch.to_pydict()
        out: dict[str, list] = {"page_id": [], "host": [], "path": [], "rule": [], "verdict": []}
        for p, key, kind, page, host, path, verdict in zip(*(cols[c] for c in ("part", "key", "kind", "page_id", "host", "path", "verdict")), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, Paths(host)))
                stack[-1][1].add(path, verdict)
                continue
            best = max((found for _, paths in stack if (found := paths.longest(path))), default=(0, 0, None, None))
            for c, x in zip(out, (page, host, path, best[2], best[3]), strict=True):
                out[c].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in list(out)[1:])]))


def below(key: Column, cuts: list[str], equal: bool = False) -> Column:
    """How many of the sorted cuts are less than key, or equal to it: found in every STEP-th cut, then in the STEP after that."""
    if not cuts:
        return F.lit(0)
    array = lambda some: F.array(*map(F.lit, some))
    count = lambda some: F.size(F.filter(some, lambda c: c <= key if equal else c < key))
    block = count(array(cuts[::STEP]))
    return F.when(block == 0, 0).otherwise(STEP * (block - 1) + count(F.slice(array(cuts), F.greatest(STEP * (block - 1) + 1, F.lit(1)), F.lit(STEP))))


def filtered(urls: DataFrame, rules: DataFrame, default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """urls(page_id, url) and rules(verdict, host, path) to page_id, host, path, rule, verdict.

    The longest rule that fits wins; of two equally long, the one with the longer host, then the greater text and
    verdict. A null url, or one without ://, has an empty host and path, which no rule fits. Rules with a null in any
    column or an empty host are dropped, repeated ones count once. Repeated rows and null ids are kept; an empty table
    of urls gives no rows, an empty one of rules gives every url the default.
    """
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    page = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    page = page.withColumn("key", key_of(F.col("host"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 20)).cast("int"))
    # about DRAWN keys for each range, drawn by row, so that a frequent key is drawn as often as it is frequent; the
    # result does not depend on the cuts
    share = DRAWN * ranges / max(1, urls.count())
    keys = sorted(r.key.encode() for r in (page.select("key").sample(share, seed=1) if share < 1 else page.select("key")).collect())
    cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    cuts = [c.decode() for c in cuts]
    # the range of a URL: equal cuts leave a run of ranges, of which the salt takes one
    low, high = below(F.col("key"), cuts), below(F.col("key"), cuts, True)
    found = page.withColumn("part", low + F.pmod("salt", high - low + 1).cast("int")).drop("salt")
    kept = rules.where("verdict IS NOT NULL AND host <> '' AND path IS NOT NULL").select("verdict", "host", "path").distinct()
    spread = kept.withColumn("key", key_of(F.col("host")))
    spread = spread.withColumn("part", F.explode(F.sequence(below(F.col("key"), cuts), below(F.concat("key", F.lit(LAST)), cuts, True))))
    both = found.select("part", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    both = both.unionByName(spread.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict"))
    swept = both.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind", "host", "path")
    out = swept.mapInArrow(tidy(sweep), "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


OP5_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fit AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fit f ON f.n = p.n AND f.k = 1
"""
