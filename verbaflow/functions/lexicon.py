"""English lexicon: overrides of stems, stop words, and a pluggable table of lemmas.

A Lexicon is two tables, lemmas(form, pos) and exceptions(form, pos, lemma), with pos one of n, v, a, r. SEED is a
small one for trying things out; a real one is read from Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Results depend on these words as they stand.
STOPWORDS = ("the", "a", "an")

# Stems that hold whatever the part of speech.
EXCEPTIONS = {
    "wrought": "wrought", "media": "media", "installed": "install", "installing": "install", "synapses": "synapse",
    "soles": "sole", "pubes": "pube", "dui": "dui", "taxis": "taxi", "alas": "alas", "corps": "corps", "cos": "cos",
    "enured": "enure", "fiver": "fiver", "hinder": "hinder", "lobed": "lobe", "offerer": "offerer", "outer": "outer",
    "sang": "sing", "singing": "sing", "solderer": "solderer", "tined": "tine", "twiner": "twiner", "us": "us",
    "teeth": "tooth", "things": "thing", "people": "person", "wo": "will", "ca": "can", "n't": "not",
}

# Stems that hold where the part of speech is unknown.
AMBIGUOUS_EXCEPTIONS = {
    "am": "be", "as": "as", "are": "be", "ate": "eat", "bent": "bend", "drove": "drive", "fell": "fall", "felt": "feel",
    "found": "find", "has": "have", "lit": "light", "lost": "lose", "sat": "sit", "saw": "see", "sent": "send",
    "shook": "shake", "shot": "shoot", "slain": "slay", "spoke": "speak", "stole": "steal", "sung": "sing",
    "thought": "think", "tore": "tear", "was": "be", "won": "win", "feed": "feed",
}

#: Detachment rules of the published Morphy algorithm: part of speech, ending, what takes its place.
DETACHMENTS = [
    ("n", "s", ""), ("n", "ses", "s"), ("n", "ves", "f"), ("n", "xes", "x"), ("n", "zes", "z"), ("n", "ches", "ch"), ("n", "shes", "sh"), ("n", "men", "man"), ("n", "ies", "y"),
    ("v", "s", ""), ("v", "ies", "y"), ("v", "es", "e"), ("v", "es", ""), ("v", "ed", "e"), ("v", "ed", ""), ("v", "ing", "e"), ("v", "ing", ""),
    ("a", "er", ""), ("a", "est", ""), ("a", "er", "e"), ("a", "est", "e"),
]
POS = "nvar"

SEED_LEMMAS = {
    "n": "dog fragment test line paragraph word time illusion page reader thing person tooth sing light man woman box church city boss glass dish knife be see seed this".split(),
    "v": "be have do can avoid test see seed say send get sing run walk make use try install find think go hate stop watch pass".split(),
    "a": "big small fast late fine okay deep good able hot".split(),
    "r": "not very now so here there".split(),
}
SEED_EXCEPTIONS = [("men", "n", "man"), ("women", "n", "woman"), ("said", "v", "say"), ("got", "v", "get"), ("ran", "v", "run"), ("seen", "v", "see"), ("better", "a", "good"), ("knives", "n", "knife")]


def _literal(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A table of words whose size Spark knows, so that it is sent to what it meets; of createDataFrame it knows none."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows) + f" AS t({names})")


@dataclass
class Lexicon:
    lemmas: DataFrame
    exceptions: DataFrame

    @classmethod
    def seed(cls, spark: SparkSession) -> Lexicon:
        lemmas = [(form, pos) for pos, forms in SEED_LEMMAS.items() for form in forms]
        return cls(_literal(spark, lemmas, "form, pos"), _literal(spark, SEED_EXCEPTIONS, "form, pos, lemma"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Lexicon:
        """From <path>/lemmas and <path>/exceptions, both Parquet."""
        return cls(spark.read.parquet(f"{path}/lemmas"), spark.read.parquet(f"{path}/exceptions"))
