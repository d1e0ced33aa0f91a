"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing and packing, each stage on all that the one
before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.llm.common import documents, emptied, spare_name, stored
from tagsim.llm.line_dedup import apply_bitmaps, line_dedup
from tagsim.llm.mixing import mix_texts
from tagsim.llm.packing import pack_documents
from tagsim.llm.quality_rules import apply_rules, quality_rules
from tagsim.llm.similar_texts import drop_similar

#: A host's line is frequent in this many different texts at least, besides its share: a group of near copies may be counted as two or three texts.
HOST_MIN_TEXTS = 5


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines above their host's limit. Near copies
    count as one text toward it. Null and empty texts go; rows that repeat stay or go together; no rows give no rows."""
    return _with_length(apply_rules(docs, quality_rules(docs, min_texts=HOST_MIN_TEXTS, near_once=True)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose key is in ten documents or more, but for the first of each. Near copies count as one
    document, and the first document keeps its lines: the next stage keeps one of a group of near copies, whose lines must not
    be lost to its copies. Null texts stay null, empty ones empty;
    rows that repeat get the same text; no rows give no rows."""
    own, n = spare_name(docs, "kept_text"), spare_name(docs, "n_dropped")
    kept = apply_bitmaps(docs, line_dedup(docs, keep_first=True, near_once=True), kept_col=own, dropped_col=n)
    return _with_length(kept.withColumn("text", F.when(F.col(n) > 0, F.col(own)).otherwise(F.col("text"))).select(*docs.columns))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id: SimHash fingerprints of shingles of five words find them, a similarity
    of 0.8 or more of the sets of shingles decides. Null texts and texts without words are one group, and so are rows that repeat. No
    rows give no rows."""
    return drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents: those of a source that is taken more than once come again, those left out are gone, and so
    are null and empty texts. A null source is a source. Rows that repeat are documents each. No rows give no rows."""
    return mix_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document. A null text has its end id
    alone. No rows give no rows."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", near_copy_stage),
    ("mix_sources", mixing_stage),
    ("pack", packing_stage),
]

#: The permutation of the mixture and the packing plan have no SQL; tests hold the pipeline against a version without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
        if k:
            emptied(before)
    return STAGES[-1][1](spark, docs, sf_dir)
