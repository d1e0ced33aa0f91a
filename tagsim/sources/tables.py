"""Schemas, readers and writers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared schemas.
CASES = "case_id LONG, title STRING, industry STRING, problem STRING, action STRING, result STRING, tags ARRAY<STRING>"
QUERIES = "query_id LONG, text STRING"
RULES = "tag STRING, pos INT, keyword STRING"
RANKED = "query_id LONG, case_id LONG, score DOUBLE, rank INT, pct INT"


def read_cases(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The case corpus with its declared schema; a null tags array is empty."""
    return spark.read.schema(CASES).format(fmt).load(path).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def read_queries(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(QUERIES).format(fmt).load(path)


def read_query_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(QUERIES).format(fmt).load(path)


def tag_rules(spark: SparkSession, rules: dict[str, list[str]] | DataFrame) -> DataFrame:
    """tag, pos, keyword, one row for each keyword; pos is the tag's place in the dictionary.

    From a dictionary; from a table of (tag, pos, keyword) or of (tag, pos, keywords); or from a table of one row and one column, a map of
    tags to keywords, whose order is the dictionary's."""
    if not isinstance(rules, DataFrame):
        return spark.createDataFrame([(tag, pos, k) for pos, (tag, keywords) in enumerate(rules.items()) for k in keywords], RULES)
    if len(rules.columns) == 1:
        rules = rules.select(F.posexplode(rules.columns[0]).alias("pos", "tag", "keywords"))
    keyword = F.col("keyword") if "keyword" in rules.columns else F.explode("keywords").alias("keyword")
    return rules.select("tag", F.col("pos").cast("int").alias("pos"), keyword)


def write_ranked(ranked: DataFrame, path: str) -> None:
    ranked.write.mode("overwrite").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def spread(df: DataFrame, key: str, files: int | None = None) -> DataFrame:
    """df in as many tasks as a shuffle has, where it is read from fewer files, or fewer than `files`: a small table often is one file that one task reads."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, key) if len(df.inputFiles()) < (files or tasks) else df


#: The temporary folder of each local session that names no shared one.
_local: dict[str, str] = {}


class _Scopes(threading.local):
    """Paths of the scopes that are open in this thread, innermost last. Batches of a stream run in threads of their own."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder of its own, and
    no setting is changed; on a cluster, where each machine would write its own, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    session = spark.sparkContext.applicationId
    if session not in _local:
        _local[session] = tempfile.mkdtemp(prefix="spark-shared-")
    return _local[session]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the innermost open scope owns it."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder, through the file system that Spark reaches it by."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that its thread writes on the way inside it, and removes them at its end, also after an error. Results are lazy and read such
    tables: use them, or write them, inside the scope. A scope within a scope owns its own."""
    made: list[str] = []
    _scopes.open.append(made)
    try:
        yield
    finally:
        _scopes.open.pop()
        for path in made:
            removed(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder: what reads it repeats none of the work behind it, and outlives lost executors. The scope
    that is open removes it at its end."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
