"""Lines of documents as hashed keys, and compressed bitmaps of the lines that a document keeps. DataFrame functions only.

A bitmap is an array of (word, bits), sorted by word, with 64 lines to a word: bit b of word w is line 64 w + b. Words whose
lines are all kept are left out, so a document that loses no line has no entry at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsim.llm.common import ascii_lower, let, strip


def split_lines(text: Column) -> Column:
    """At \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(strip(line))


def key_hashes(key: Column) -> list[Column]:
    """128 bits of a key, as two columns."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def distinct_keys(docs: DataFrame, keep: list[str], text: str = "text", min_chars: int = 1) -> DataFrame:
    """One row for each different key of each row of docs: keep, h1, h2."""
    keys = docs.select(*keep, F.explode(F.array_distinct(F.transform(split_lines(F.col(text)), line_key))).alias("key"))
    return keys.filter(F.length("key") >= min_chars).select(*keep, *key_hashes(F.col("key")))


def placed_keys(docs: DataFrame, keep: list[str], text: str = "text", min_chars: int = 1) -> DataFrame:
    """One row for each line of each row of docs: keep, pos, h1, h2."""
    lines = docs.select(*keep, F.posexplode(F.transform(split_lines(F.col(text)), line_key)).alias("pos", "key"))
    return lines.filter(F.length("key") >= min_chars).select(*keep, "pos", *key_hashes(F.col("key")))


def drop_bitmaps(dropped: DataFrame, key: str) -> DataFrame:
    """dropped: key, pos of each line to drop. One row for each key: the bits that are set in `drops` are the dropped lines'."""
    words = dropped.groupBy(key, F.expr("int(pos div 64)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def keep_bitmap(drops: Column) -> Column:
    return F.transform(drops, lambda w: F.struct(w["word"].alias("word"), F.bitwise_not(w["bits"]).alias("bits")))


def dropped_positions(drops: Column) -> Column:
    return F.flatten(F.transform(drops, lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(w["bits"], b) == 1, w["word"] * 64 + b)), lambda p: p.isNotNull())))


def n_dropped(drops: Column) -> Column:
    return F.coalesce(F.aggregate(drops, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"])), F.lit(0).cast("long"))


def kept_text(text: Column, drops: Column) -> Column:
    """The lines that are kept, joined by \\n; time grows with the number of lines, not with its square."""
    def pick(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped_positions(drops))
        return F.array_join(F.transform(left, lambda p: F.get(lines, p)), "\n")

    return F.when(drops.isNull(), F.coalesce(text, F.lit(""))).otherwise(let(split_lines(text), pick))
