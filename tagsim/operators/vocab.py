"""The corpus's vocabulary, and tag sets as vectors over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsim.sources.tables import written

#: Tags that one number holds as a mask.
MASK_BITS = 63
#: Tags that may be in the driver's hands at once, for those who ask for a list.
MAX_LISTED = 100_000
#: Rows of a table that may be sent to every executor once it has been counted.
MAX_BROADCAST = 200_000


def explode_tags(df: DataFrame, id_col: str, tags_col: str = "tags") -> DataFrame:
    """id_col, pos, tag, one row for each different tag of each row."""
    return df.select(id_col, F.posexplode(F.array_distinct(F.coalesce(tags_col, F.array().cast("array<string>")))).alias("pos", "tag"))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with consecutive numbers from 0 in the order of the columns `order`, for tables of any size. A small table is numbered by a window; the rows of others are
    dealt into sorted ranges, each range is numbered by itself, and the lengths of the ranges before it, one number for each, are added up."""
    rows = written(df, "unnumbered")
    if rows.count() <= MAX_BROADCAST:
        return rows.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    # the id's upper 31 bits are the partition, the lower 33 the place in it; written once, so that all reads see the same
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    lengths = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as ranges
    starts = lengths.select("__part", before.alias("__before"))
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(out, F.col("__before") + place).drop("__part", "__before", "__id")


def _first_seen(cases: DataFrame, id_col: str, tags_col: str) -> DataFrame:
    return explode_tags(cases, id_col, tags_col).groupBy("tag").agg(F.min(F.struct(id_col, "pos")).alias("seen"))


def build_vocab(cases: DataFrame, id_col: str = "case_id", tags_col: str = "tags") -> DataFrame:
    """tag, idx (long), in the order in which the corpus, by id, shows them first. For vocabularies of any size."""
    return numbered(_first_seen(cases, id_col, tags_col), ["seen", "tag"], "idx").select("tag", "idx")


def vocab_list(vocab: DataFrame) -> list[str]:
    """The tags in order, MAX_LISTED at most; larger vocabularies stay tables."""
    listed = vocab.limit(MAX_LISTED + 1).collect()
    if len(listed) > MAX_LISTED:
        raise ValueError(f"a vocabulary of over {MAX_LISTED} tags is used as a table")
    return [r["tag"] for r in sorted(listed, key=lambda r: r["idx"])]


@dataclass
class Vocabulary:
    """A vocabulary as a table (tag, idx) of `size` rows. Only those that a mask holds are listed too; `tags` is None for others."""

    table: DataFrame
    size: int
    tags: list[str] | None

    @classmethod
    def of(cls, vocab: DataFrame) -> Vocabulary:
        vocab = vocab.select("tag", F.col("idx").cast("long").alias("idx"))
        first = vocab.limit(MASK_BITS + 1).collect()
        if len(first) <= MASK_BITS:
            return cls.listed(vocab.sparkSession, [r["tag"] for r in sorted(first, key=lambda r: r["idx"])])
        table = written(vocab, "vocabulary")
        return cls(table, table.count(), None)

    @classmethod
    def of_cases(cls, cases: DataFrame, id_col: str = "case_id", tags_col: str = "tags") -> Vocabulary:
        """That of build_vocab; of few tags, without a table on the way."""
        seen = _first_seen(cases, id_col, tags_col)
        first = seen.limit(MASK_BITS + 1).collect()
        if len(first) <= MASK_BITS:
            return cls.listed(cases.sparkSession, [r["tag"] for r in sorted(first, key=lambda r: (*r["seen"], r["tag"]))])
        return cls.of(numbered(seen, ["seen", "tag"], "idx"))

    @classmethod
    def listed(cls, spark: SparkSession, tags: list[str] | Vocabulary) -> Vocabulary:
        """From a list of tags in order; a vocabulary stays as it is."""
        if isinstance(tags, Vocabulary):
            return tags
        return cls(spark.createDataFrame([(t, i) for i, t in enumerate(tags)], "tag string, idx long"), len(tags), tags if len(tags) <= MASK_BITS else None)

    def near(self) -> DataFrame:
        """The table, sent to every executor where it is small."""
        return F.broadcast(self.table) if self.size <= MAX_BROADCAST else self.table


def _array(tags: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in tags]).cast("array<string>")


def in_vocab(df: DataFrame, tags: list[str] | Vocabulary, tags_col: str = "tags", id_col: str = "case_id") -> DataFrame:
    """df with only the tags of the vocabulary, each once, in the vocabulary's order. A vocabulary that is not listed is joined, by id_col, which
    then names each row once."""
    if isinstance(tags, Vocabulary) and tags.tags is None:
        own = explode_tags(df, id_col, tags_col).join(tags.near(), "tag").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "tag"))).alias("__known"))
        known = F.coalesce(F.transform("__known", lambda k: k["tag"]), F.array().cast("array<string>"))
        return df.join(own, id_col, "left").withColumn(tags_col, known).select(*df.columns)
    listed = tags.tags if isinstance(tags, Vocabulary) else tags
    return df.withColumn(tags_col, F.array_intersect(_array(listed), F.coalesce(tags_col, F.array().cast("array<string>"))))


def multi_hot(df: DataFrame, tags: list[str], tags_col: str = "tags", out: str = "vector") -> DataFrame:
    own = F.coalesce(tags_col, F.array().cast("array<string>"))
    return df.withColumn(out, F.transform(_array(tags), lambda t: F.array_contains(own, t).cast("int")))


def tag_mask(df: DataFrame, tags: list[str] | Vocabulary, tags_col: str = "tags", out: str = "mask") -> DataFrame:
    """A bit for each tag of the vocabulary, which has 63 tags at most; tags outside it count for nothing."""
    tags = tags.tags if isinstance(tags, Vocabulary) else tags
    if tags is None or len(tags) > MASK_BITS:
        raise ValueError(f"a mask holds {MASK_BITS} tags")
    mask = F.lit(0).cast("long")
    for i, t in enumerate(tags):
        mask = mask + F.when(F.array_contains(tags_col, t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return df.withColumn(out, F.coalesce(mask, F.lit(0).cast("long")))


def tag_words(df: DataFrame, vocab: Vocabulary, id_col: str, tags_col: str = "tags", out: str = "mask") -> DataFrame:
    """id_col, out: a mask of several 64-bit words over a vocabulary of any size, for each row that has a known tag. The mask is an array of (word,
    bits), by word, without words that have no bit; bit b of word w is tag 64 w + b. id_col names each row once."""
    known = explode_tags(df, id_col, tags_col).join(vocab.near(), "tag")
    # bits come together in their words before anything is shuffled
    words = known.groupBy(id_col, F.expr("int(idx div 64)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(idx % 64))")).alias("bits"))
    return words.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias(out))


def word_tags(mask: Column) -> Column:
    """The numbers of a mask's tags, ascending."""
    return F.flatten(F.transform(mask, lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 1), lambda b: w["word"].cast("long") * 64 + b)))
