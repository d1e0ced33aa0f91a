"""Which texts are near copies of each other, told roughly and cheaply, for counts in which near copies stand for one text. DataFrame functions only.

A text's sketch is the least hashes of its word shingles; the least of two texts together, and how many of those both have, tell the similarity (Jaccard) of their sets
of shingles. Texts that share one of their very least hashes are compared with one text of those that do, never with each other, so the work grows
with the texts, and a group of any size is as many comparisons as it has members. A passage that many texts share may hide a group behind a foreign text in one such
comparison; there are several for each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsim.llm.common import ascii_lower, let, split_words, stored

SHINGLE, SIMILARITY = 5, 0.8
#: Hashes of a sketch; those by which texts meet one by one, and those of the keys that are made of several.
SKETCH, SINGLE, SEVERAL = 32, 4, (3, 6)
#: Rows of a table that may be sent to every executor once it has been counted.
MAX_BROADCAST = 200_000


def text_unit(text: Column) -> Column:
    """A text as a number; exact copies share it."""
    return F.xxhash64(text)


def shingle_sketch(text: Column) -> Column:
    """The SKETCH least of the different hashes of a text's shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    def shingles(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        each = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(h) == 0, F.slice(h, 1, 0)).when(F.size(h) < SHINGLE, whole).otherwise(each)

    hashes = let(F.transform(split_words(ascii_lower(text)), lambda w: F.xxhash64(w)), shingles)
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, SKETCH)


def sketch_similarity(a: Column, b: Column) -> Column:
    """The share of the SKETCH least hashes of both together that both have."""
    return let(F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH), lambda least: F.size(F.array_intersect(F.array_intersect(least, a), b)) / F.size(least))


def text_groups(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """unit, text_group: texts that stand for another one, with that one's unit; other texts have no row. Null texts and texts without words stand for themselves."""
    own = docs.select(text_unit(F.col(text_col)).alias("unit"), shingle_sketch(F.col(text_col)).alias("sketch")).groupBy("unit").agg(F.first("sketch").alias("sketch"))
    # filtered as a table: a filter on what is worked out would work it out twice
    own = stored(own, "text_sketches").filter(F.size("sketch") > 0)
    single = F.slice("sketch", 1, SINGLE)
    several = F.array(*[F.xxhash64(F.lit(n), F.slice("sketch", 1, n)) for n in SEVERAL])
    met = own.select("unit", "sketch", F.explode(F.concat(single, several)).alias("meeting"))
    # as a table: only a join of two plain exchanges is split where a key is hot
    first = stored(met.groupBy("meeting").agg(F.min(F.struct("unit", "sketch")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("meeting", "first"), "text_meetings")
    alike = met.join(first, "meeting").filter((F.col("unit") != F.col("first.unit")) & (sketch_similarity(F.col("sketch"), F.col("first.sketch")) >= similarity))
    near = stored(alike.groupBy("unit").agg(F.min("first.unit").alias("text_group")), "text_near")
    # the text that one stands for may itself stand for another
    onward = near.select(F.col("unit").alias("text_group"), F.col("text_group").alias("onward"))
    onward = F.broadcast(onward) if near.count() <= MAX_BROADCAST else onward
    return stored(near.join(onward, "text_group", "left").select("unit", F.coalesce("onward", "text_group").alias("text_group")), "text_groups")


def grouped_units(rows: DataFrame, groups: DataFrame, unit: str) -> DataFrame:
    """rows with their column `unit` (from text_unit) replaced by the unit that the text stands for."""
    groups = groups.select(F.col("unit").alias(unit), "text_group")
    groups = F.broadcast(groups) if groups.count() <= MAX_BROADCAST else groups
    return rows.join(groups, unit, "left").withColumn(unit, F.coalesce("text_group", unit)).drop("text_group")
