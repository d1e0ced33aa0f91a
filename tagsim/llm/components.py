"""Connected components of a link table, by alternating large stars and small stars, in Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsim.llm.common import emptied, stored


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node hangs its larger neighbours under its least neighbour (itself included). With the table that was made on the way."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # as a table: only a join of two plain exchanges is split where a node has many links, not one with an aggregate on its way
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least_neighbours")
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(links: DataFrame) -> DataFrame:
    """links: (a, b) with b < a. Each node hangs its smaller neighbours and itself under its least neighbour."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links: a, b (long; any order, repeats allowed). (node, component) for each node of a link between different nodes; component
    is the least node that links reach. A node without links has no row.

    Each round writes its links to the shared folder and removes those of the round before. They become stars in a number of rounds that grows with the logarithm of the
    longest chain; the loop ends when a round changes nothing."""
    now = stored(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        # sums of hashes tell whether the set of links has changed
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = new
        hung, least = _large_star(now)
        after = stored(_small_star(hung), name)
        emptied(now, least)
        now = after
