"""Analyzer configurations: key=value files, and splitter files of tagged sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = r"^\s*(\w+)\s*=\s*(.*?)\s*$"


def settings(lines: DataFrame, *keep: str) -> DataFrame:
    """(*keep, key, value) of the lines(value) that set something; comments and blank lines set nothing."""
    rows = lines.where(F.col("value").rlike(SETTING) & ~F.col("value").startswith("#"))
    return rows.select(*keep, F.regexp_extract("value", SETTING, 1).alias("key"), F.regexp_extract("value", SETTING, 2).alias("value"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return settings(spark.read.text(path))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, at, line) of a small file of <Section> ... </Section> blocks, read whole."""
    text = spark.read.text(path, wholetext=True).select("value")
    block = r"(?s)<(\w+)>\n(.*?)</\w+>"
    names = F.regexp_extract_all("value", F.lit(block), F.lit(1))
    bodies = F.regexp_extract_all("value", F.lit(block), F.lit(2))
    rows = text.select(F.explode(F.arrays_zip(names.alias("section"), bodies.alias("body"))).alias("b"))
    return rows.select("b.section", F.posexplode(F.filter(F.split("b.body", "\n"), lambda x: x != "")).alias("at", "line"))
