"""The test tables as cases, queries and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.sources.tables import spread, tag_rules

#: The dictionary for the test tables, whose prose is made of invented syllables.
RULES = {
    "amber": ["tionthe", "theand", "inthe"],
    "birch": ["rethe", "anthe", "ofthe"],
    "cobalt": ["ingthe", "edthe", "eding"],
    "dune": ["thesh", "shand", "ndth"],
    "ember": ["wher", "there", "ther"],
    "fjord": ["eauou", "ouqu", "reéa"],
    "grove": ["mentan", "antre", "iermen"],
    "harbor": ["aichan", "auxque", "ellele"],
    "inlet": ["ui"],
    "juniper": ["ungver", "versch", "schge"],
    "kelp": ["heitun", "eitver", "enschach"],
    "lagoon": ["ciónes", "adociónn", "ciónra"],
    "marsh": ["arlos", "menteci", "osasc", "asra"],
    "nectar": ["token", "http", "@", "license"],
}


#: A dictionary with a tag for each of many syllables, which are their own keywords: (consonant, vowel, consonant).
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"


def syllables(first: str) -> dict[str, list[str]]:
    return {a + b + c: [a + b + c] for a in first for b in VOWELS for c in CONSONANTS}


#: Over 63 tags that occur; over 2000 keywords.
WIDE, LARGE = syllables("bgkpvxz"), syllables(CONSONANTS)


def rules(spark: SparkSession) -> DataFrame:
    return tag_rules(spark, RULES)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("case_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("industry"), F.col("text").alias("problem"), none.alias("action"), none.alias("result"))


def queries(spark: SparkSession, sf_dir: str, turns: DataFrame | None = None) -> DataFrame:
    """The users' turns, from the table or from a stream of its rows."""
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id") if turns is None else turns
    return turns.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def _words(text):
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \n]+", -1), lambda w: w != ""))


def word_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, tags: the documents with their own words as tags, as hand-given ones of a vocabulary that grows with the table. Whole texts are dealt out only where there are
    fewer files than cores, as some steps read them more than once."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", spark.sparkContext.defaultParallelism)
    return docs.select(F.col("doc_id").alias("case_id"), _words(F.col("text")).alias("tags"))


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, tags: the users' turns with their own words as tags."""
    return queries(spark, sf_dir).select("query_id", _words(F.col("text")).alias("tags"))
