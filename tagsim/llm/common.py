"""What several operators share: ASCII text rules, tables in the shared folder, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.sources.tables import scratch_root

#: The ASCII white space that separates words, as characters and as a class of a Java pattern.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; on
    a cluster, where each machine would write its own, it is an error."""
    return scratch_root(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read again: cuts the lineage and outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_path = path
    return found


def emptied(*tables: DataFrame) -> None:
    """Removes the rows of tables made by stored() that nothing will read again: each is overwritten by an empty one."""
    for table in tables:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(table.stored_path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, however often body uses it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """The words of a text, none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*cols: Column) -> Column:
    """A key of a row's values that tells null from every value: 128 bits, as a struct (a, b). Rows that repeat share a key, and also all
    that is worked out from them."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


#: Its type.
ROW_KEY = "struct<a: long, b: long>"

#: Copies of a row that go through a window or to a task as one row.
RUN = 1024


def copy_runs(rows: DataFrame) -> DataFrame:
    """rows: copies (how often a row stands for itself, 1 at least) and others. Each row as runs of RUN copies at most: run (from 0), and copies of the run.
    Where `run` is part of the key that deals rows to tasks, a row that repeats any number of times is spread over them."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {RUN}"))))
    return runs.withColumn("copies", F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("run") * RUN))


def each_copy(runs: DataFrame) -> DataFrame:
    """One row for each copy of copy_runs: `of_run`, its number in the run from 0."""
    return runs.withColumn("of_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


def spare_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it: one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
