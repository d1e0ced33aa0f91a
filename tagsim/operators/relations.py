"""Relations inside each query's result list: related cases, and node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsim.functions.similarity import mask_cosine, match_pct, word_cosine
from tagsim.operators.search import of_listed
from tagsim.operators.vocab import MAX_BROADCAST
from tagsim.sources.tables import written

THRESHOLD = 0.35


def _pairs(ranked: DataFrame, masks: DataFrame, condition: str) -> DataFrame:
    """Pairs within a list; a list has at most k cases, so a query has at most k * k pairs. A mask is a number, or, of a vocabulary of over 63 tags, one of
    several words: those are joined to the different pairs of cases, not carried along with the lists."""
    lists = ranked.select("query_id", "case_id", "rank")
    narrow = dict(masks.dtypes)["mask"] == "bigint"
    own = written(lists.join(masks.select("case_id", "mask"), "case_id") if narrow else lists, "lists")
    a, b = own.alias("a"), own.alias("b")
    joined = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & F.expr(condition))
    columns = [F.col("a.query_id").alias("query_id"), F.col("a.case_id").alias("a_id"), F.col("b.case_id").alias("b_id"), F.col("a.rank").alias("a_rank"), F.col("b.rank").alias("b_rank")]
    if narrow:
        return joined.select(*columns, mask_cosine(F.col("a.mask"), F.col("b.mask")).alias("sim"))
    pairs = joined.select(*columns)
    listed = written(of_listed(own, masks.select("case_id", "mask")), "listed_masks")
    few = listed.count() <= MAX_BROADCAST // 10
    sims = pairs.select("a_id", "b_id").distinct()
    for end in ("a", "b"):
        ends = listed.select(F.col("case_id").alias(f"{end}_id"), F.col("mask").alias(f"{end}_mask"))
        sims = sims.join(F.broadcast(ends) if few else ends, f"{end}_id")
    return pairs.join(sims.select("a_id", "b_id", word_cosine(F.col("a_mask"), F.col("b_mask")).alias("sim")), ["a_id", "b_id"])


def related(ranked: DataFrame, masks: DataFrame, k: int = 3) -> DataFrame:
    """ranked: query_id, case_id, rank; masks: case_id, mask. For each listed case the other cases of the list, most alike first, ties by
    their rank in the list."""
    order = Window.partitionBy("query_id", "a_id").orderBy(F.desc("sim"), "b_rank")
    found = _pairs(ranked, masks, "a.case_id != b.case_id").filter("sim > 0").withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
    return found.select("query_id", F.col("a_id").alias("case_id"), F.col("b_id").alias("related_id"), "sim", match_pct(F.col("sim")).alias("sim_pct"), "pos")


def pair_edges(ranked: DataFrame, masks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each pair of a list once, from the better to the worse rank, at `threshold` or above."""
    found = _pairs(ranked, masks, "a.rank < b.rank").filter(F.col("sim") >= threshold)
    return found.select("query_id", F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.col("sim").alias("weight"))


def star_edges(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", F.col("case_id").alias("dst"), F.col("score").alias("weight"))


def graph_edges(ranked: DataFrame, masks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, kind (star or pair), src (null for star), dst, weight."""
    star = star_edges(ranked).select("query_id", F.lit("star").alias("kind"), F.lit(None).cast("long").alias("src"), "dst", "weight")
    return star.unionByName(pair_edges(ranked, masks, threshold).withColumn("kind", F.lit("pair")))


def graph_nodes(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, case_id, label (the title, cut to 11 characters and an ellipsis if longer than 12), score, rank. Characters are code
    points. Only the titles of ranked cases are joined."""
    ranked = written(ranked, "ranked")
    label = F.when(F.length("title") > 12, F.concat(F.substring("title", 1, 11), F.lit("…"))).otherwise(F.col("title"))
    return ranked.join(of_listed(ranked, cases.select("case_id", label.alias("label"))), "case_id").select("query_id", "case_id", "label", "score", "rank")
