"""Line dedup: range-partitioned line hashes with a secondary sort by document and position are streamed once for each key's documents and
first occurrence; compressed bitmaps say which lines each document keeps. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsim.llm.common import documents, emptied, row_key, spare_name, stored
from tagsim.llm.lines import drop_bitmaps, keep_bitmap, kept_text, n_dropped, placed_keys, split_lines
from tagsim.llm.text_groups import grouped_units, text_groups, text_unit

#: A key of this many documents is boilerplate.
MIN_DOCS = 10
#: Parts into which the documents of a key are dealt, so that a hot key spreads over several ranges.
PARTS = 64


def streamed_keys(lines: DataFrame, unit: str, min_docs: int) -> DataFrame:
    """lines: doc_id, row_key, pos, h1, h2 and the column `unit` (what counts as one document), one row for each line. Keys of at least
    min_docs documents: h1, h2, n_docs, and the first line's place in order of (doc_id, row_key, pos): first.

    Lines are dealt into ranges of (h1, h2, part), part being a hash of the document, and sorted by (h1, h2, part, document, place). Each
    range is streamed once: a line whose document differs from the line before it begins a new document of its key, and the first
    of a key in its range is its first place there. A key has one row for each range that it reaches into; only these are shuffled
    and added up."""
    part = F.pmod(F.xxhash64(unit), F.lit(PARTS)).cast("int")
    order = ["h1", "h2", "part", unit, "doc_id", "row_key", "pos"]
    ranged = lines.withColumn("part", part).repartitionByRange("h1", "h2", "part").sortWithinPartitions(*order)
    # the ranges hold whole (h1, h2, part), sorted, so the window neither shuffles nor sorts again
    run = Window.partitionBy("h1", "h2", "part").orderBy(*order[3:])
    begins = ~F.col(unit).eqNullSafe(F.lag(unit).over(run)) | (F.row_number().over(run) == 1)
    firsts = ranged.withColumn("begins", begins).filter("begins")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row_key", "pos")
    return firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(place).alias("first")).filter(F.col("n_docs") >= min_docs)


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", near_once: bool = False) -> DataFrame:
    """doc_id, row_key, n_lines, n_dropped, keep (bitmap; null if all lines stay), for each row of docs.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of min_docs documents or more lose all
    their lines; with keep_first, the first line in order of (doc_id, row_key, position) stays. Documents are told apart by id, rows
    with a null id by their text. With near_once, copies and near copies (text_groups) count as one document, so that
    they do not turn their own lines into boilerplate; lines of frequent keys go in all rows. Keys under min_chars
    code points stay. A null text is one empty line. A null id sorts first. Rows that repeat are one document and get the same
    bitmap. An empty table gives an empty table. Other columns of docs aren't read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = own.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    # hashes are worked out once, in this table; ranges are cut from a sample of it, and its size is known to the joins below
    unit = text_unit(F.col("text")) if near_once else F.when(F.col("doc_id").isNull(), F.col("row_key")).otherwise(row_key(F.col("doc_id")))
    lines = placed_keys(own.withColumn("unit", unit), ["doc_id", "row_key", "unit"], min_chars=min_chars)
    lines = grouped_units(lines, text_groups(own), "unit") if near_once else lines
    lines = stored(lines, "placed_lines")
    hot = stored(streamed_keys(lines, "unit", min_docs), "hot_keys")
    gone = lines.select("row_key", "pos", "h1", "h2").join(hot, ["h1", "h2"])
    if keep_first:
        gone = gone.filter(~((F.col("row_key") == F.col("first.row_key")) & (F.col("pos") == F.col("first.pos"))))
    drops = stored(drop_bitmaps(gone, "row_key"), "line_bitmaps")
    emptied(lines, hot)
    counts = own.select("doc_id", "row_key", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"))
    return counts.join(drops, "row_key", "left").select("doc_id", "row_key", "n_lines", n_dropped(F.col("drops")).alias("n_dropped"), keep_bitmap(F.col("drops")).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept_text", dropped_col: str = "n_dropped") -> DataFrame:
    """docs with the lines that the bitmaps keep, as column kept_col, and their number dropped_col; columns of docs that have these two
    names are replaced, so choose others where there are such. Rows without a bitmap keep all lines; a null text becomes an empty one.
    Rows are found again by a key of id and text, nulls included. An empty table gives an empty table."""
    key, gone, n = (spare_name(docs, x) for x in ("key", "gone", "n"))
    drops = F.transform("keep", lambda w: F.struct(w["word"].alias("word"), F.bitwise_not(w["bits"]).alias("bits")))
    own = bitmaps.filter(F.col("n_dropped") > 0).select(F.col("row_key").alias(key), drops.alias(gone), F.col("n_dropped").alias(n)).dropDuplicates([key])
    joined = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col))).join(own, key, "left")
    return joined.withColumns({kept_col: kept_text(F.col(text_col), F.col(gone)), dropped_col: F.coalesce(n, F.lit(0).cast("long"))}).drop(key, gone, n)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = apply_bitmaps(docs, line_dedup(docs))
    return kept.select("doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"), "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
