"""Tags of unknown words by their endings, after Brants, "TnT: A Statistical Part-of-Speech Tagger" (2000).

A tagged corpus gives each ending of up to LONGEST letters the counts of its words' tags. A word's tags are those of its longest
known ending, smoothed with the next shorter one, and so on down to no letters at all, the shares of all words. The weight of
the shorter ending is the variance of those shares. Endings are rows, and a word meets its at most LONGEST + 1 of them
in one join and one fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hmm import TAGS

LONGEST = 6
#: Tags that are less likely than this are none of a word's, as analyzers have it.
LEAST = 0.001
#: Probabilities are compared in this many parts of one, so that equal ones stay equal.
PARTS = 1_000_000_000


@dataclass
class Endings:
    """table(ending, counts), counts by tag; weight of the shorter ending."""

    table: DataFrame
    weight: float
    tags: tuple[str, ...]


def learned(words: DataFrame, tags: tuple[str, ...] = TAGS, longest: int = LONGEST) -> Endings:
    """words(word, tag, n); tags that aren't among `tags` are left out. Without words every tag is as likely as another."""
    rows = words.where(F.col("tag").isin(*tags)).select(F.explode(F.sequence(F.lit(0), F.least(F.lit(longest), F.length("word")))).alias("k"), "word", "tag", "n")
    own = [F.sum(F.when(F.col("tag") == tag, F.col("n")).otherwise(0)) for tag in tags]
    table = rows.groupBy(F.right("word", F.col("k")).alias("ending")).agg(F.array(*own).alias("counts"))
    every = table.where("ending = ''").first()
    total = sum(every.counts) if every else 0
    shares = [c / total for c in every.counts] if total else [1 / len(tags)] * len(tags)
    mean = 1 / len(tags)
    return Endings(table, sum((p - mean) ** 2 for p in shares) / (len(tags) - 1), tags)


def guessed(words: DataFrame, endings: Endings, longest: int = LONGEST, least: float = LEAST) -> DataFrame:
    """words(word, ...) with guesses, array<struct<parts, tag>>: the tags of `least` probability or more, the likeliest first,
    of equals the first in order; parts is the probability in PARTS. Words are distinct; a null word has null."""
    asked = words.where("word IS NOT NULL").select("word", F.explode(F.sequence(F.lit(0), F.least(F.lit(longest), F.length("word")))).alias("k"))
    met = asked.withColumn("ending", F.right("word", F.col("k"))).join(endings.table, "ending")
    chains = met.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "counts"))).alias("chain"))
    weight, k = F.lit(endings.weight), len(endings.tags)

    def shorter(p, link):
        total = F.aggregate(link["counts"], F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(p, link["counts"], lambda old, n: F.when(link["k"] == 0, n / total).otherwise((n / total + weight * old) / (1 + weight)))

    p = F.aggregate("chain", F.array(*[F.lit(1 / k)] * k), shorter)
    order = {tag: i for i, tag in enumerate(endings.tags)}
    scored = F.transform(p, lambda x, i: F.struct((-F.round(x * PARTS).cast("long")).alias("less"), i.alias("at")))
    kept = F.filter(F.array_sort(scored), lambda s: -s["less"] >= int(least * PARTS))
    names = F.array(*map(F.lit, order))
    made = F.transform(kept, lambda s: F.struct((-s["less"]).alias("parts"), F.get(names, s["at"]).alias("tag")))
    return words.join(chains.select("word", made.alias("guesses")), "word", "left")
