"""A stream of query texts against a static corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tagsim.plans.workloads import Corpus, ranked_search
from tagsim.sources.tables import RANKED, scratch_scope


def rank_stream(queries: DataFrame, corpus: Corpus, rules: DataFrame, path: str, checkpoint: str, k: int = 6) -> StreamingQuery:
    """Ranks each micro-batch of queries (query_id, text) as a batch would and writes it under path, a folder for each batch id: a batch
    that runs again after a failure overwrites its own rows. Stateless, with the corpus as it is at the start: its search index is made
    once and read by every batch, whose own tables are removed when it has been written."""
    spark = queries.sparkSession
    corpus.index(k)
    # a stream without rows leaves an empty table, not a missing one
    spark.createDataFrame([], RANKED).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def rank(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            ranked_search(batch, corpus, rules, k).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return queries.writeStream.foreachBatch(rank).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
