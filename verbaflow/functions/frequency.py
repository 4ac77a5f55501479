"""Word frequency lists: reading, normalising, merging and writing tables of (word, freq)."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = r"^(\d+) (\d+(?:\.\d+)?) (\S+)\s*$"
#: Total frequency of each list in a merge.
MASS = 1e9


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(rank, freq, word) of a list with lines `rank freq word`; the lines before the list are no such lines."""
    return parse_list(spark.read.text(path))


def parse_list(lines: DataFrame, *keep: str) -> DataFrame:
    """(*keep, rank, freq, word) of lines(value) that are entries of a list."""
    rows = lines.where(F.col("value").rlike(LINE))  # of these, what stands between the spaces
    part = lambda n: F.split_part("value", F.lit(" "), F.lit(n))
    return rows.select(*keep, part(1).cast("int").alias("rank"), part(2).cast("decimal(12,2)").alias("freq"), F.rtrim(part(3), F.lit("\t\n\x0b\f\r")).alias("word"))


def ranked(counts: DataFrame, key: str) -> DataFrame:
    """counts(key, word, n) with rank: the place of a word in its key's list, the most frequent first, then by word.

    Words are numbered inside parts that follow each other in that order: an eighth of a doubling of n, and where that is
    one n, a beginning of words. Only the parts of a key, whose number the alphabet bounds, meet in one task.
    """
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    head = F.when(F.col("n") < 16, F.left("word", F.lit(3))).otherwise("").alias("head")
    rows = counts.select("*", level, head)
    sizes = rows.groupBy(key, "level", "head").agg(F.count(F.lit(1)).alias("size"))
    ahead = Window.partitionBy(key).orderBy(F.col("level").desc(), "head").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(key, "level", "head", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy(key, "level", "head").orderBy(F.col("n").desc(), "word")
    placed = rows.withColumn("rank", F.row_number().over(inside)).join(before, [key, "level", "head"])
    return placed.withColumn("rank", F.col("rank") + F.col("before")).drop("level", "head", "before")


def renormalized(words: DataFrame, normalize, *keys: str) -> DataFrame:
    """(*keys, word, freq) after normalize, a function of the word column; words of a list that become equal add up."""
    return words.select(*keys, normalize(F.col("word")).alias("word"), "freq").groupBy(*keys, "word").agg(F.sum("freq").alias("freq"))


def translated(words: DataFrame, analyze: Callable[[DataFrame], DataFrame], *keys: str, memory: str | None = None) -> DataFrame:
    """words(*keys, word, freq) with each word's lemma in its place; words of a list that get one lemma add up.

    analyze makes (word, lemma) of words(word), and is asked for each distinct word once, however many lists hold it; a word
    without an answer, or with a null one, stays as it is. memory: a folder in which answers are kept as Parquet, so that a
    later call asks for new words only.
    """
    asked = words.select("word").where("word IS NOT NULL").distinct()
    if memory is None:
        answers = analyze(asked)
    else:
        spark = words.sparkSession
        schema = "word string, lemma string"
        with contextlib.suppress(AnalysisException):  # nothing is kept yet
            asked = asked.join(spark.read.schema(schema).parquet(memory), "word", "left_anti")
        analyze(asked).select("word", "lemma").write.mode("append").parquet(memory)
        answers = spark.read.schema(schema).parquet(memory)
    rows = words.join(answers.select("word", "lemma"), "word", "left")
    return rows.select(*keys, F.coalesce("lemma", "word").alias("word"), "freq").groupBy(*keys, "word").agg(F.sum("freq").alias("freq"))


def merged_lists(rows: DataFrame, key: str, mass: Column | float = MASS) -> DataFrame:
    """(word, freq) of all the lists in rows(key, word, freq), each scaled to its mass first."""
    mass = mass if isinstance(mass, Column) else F.lit(mass)
    freq = F.col("freq").cast("double")
    totals = rows.groupBy(key).agg(F.sum(freq).alias("total"))
    return rows.join(F.broadcast(totals), key).select("word", (freq * mass / F.col("total")).alias("freq")).groupBy("word").agg(F.sum("freq").alias("freq"))


def merged(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """(word, freq) of several lists, each scaled to its mass first."""
    rows = [words.select(F.lit(k).alias("list"), F.lit(float(mass)).alias("mass"), "word", "freq") for k, (words, mass) in enumerate(lists)]
    return merged_lists(functools.reduce(DataFrame.unionByName, rows), "list", F.col("mass"))


def average(words: DataFrame, *keys: str) -> DataFrame:
    """One row, or one for each list: total, n and mean of the frequencies."""
    freq = F.col("freq").cast("double")
    return words.groupBy(*keys).agg(F.sum(freq).alias("total"), F.count(freq).alias("n"), F.avg(freq).alias("mean"))


def logarithmic(freq: Column) -> Column:
    """Base 10, to four places; null for what has no logarithm."""
    return F.when(freq > 0, F.round(F.log10(freq.cast("double")), 4))


def save(words: DataFrame, path: str) -> None:
    """Tab-separated word and frequency, the most frequent first."""
    words.select("word", "freq").orderBy(F.col("freq").desc(), "word").write.mode("overwrite").option("sep", "\t").csv(path)


def save_logarithmic(words: DataFrame, path: str) -> None:
    save(words.select("word", logarithmic(F.col("freq")).alias("freq")), path)


def word_frequency(words: DataFrame, frequencies: DataFrame, default: float = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """words(*keys, word) with freq from the list (of the same keys), or default."""
    on = [*keys, "word"]
    return words.join(frequencies.select(*on, F.col("freq").cast("double").alias("freq")), on, "left").withColumn("freq", F.coalesce("freq", F.lit(float(default))))
