"""Token counts of whole texts. Huge documents are cut into overlapping chunks that are encoded with offsets in different tasks, and
spliced where both encodings have a boundary that no neighbour can move; where an overlap holds none, the overlaps are widened.

Why a boundary is stable: the vocabulary drops white space, its pattern never matches across it, and neither normalisation nor
lower-casing joins characters across it. So the tokens from a word's first character on, a word that follows white space, are the same
whatever stands before; and those before it the same whatever follows. A place after white space at which both chunks begin a token is
such a boundary in the whole document too."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsim.llm.common import ROW_KEY, documents, row_key, stored
from tagsim.llm.tokens import count_tokens, tokenizer

LIMIT = 2048
#: A longer text, in characters, is huge. A chunk's characters and its overlap with the next.
HUGE = 32_768
OVERLAP = 256
WHITE = " \t\n\r"
#: Texts that are counted at once.
BATCH_DOCS = 512


def _boundaries(text: str, offsets: list[tuple[int, int]], low: int, high: int) -> tuple[list[int], list[int]]:
    """Places p with low <= p < high, after white space, at which a token begins; and how many tokens begin before each."""
    # offsets ascend, so the first of the region is found by bisection
    a, b = 0, len(offsets)
    while a < b:
        m = (a + b) // 2
        a, b = (m + 1, b) if offsets[m][0] < low else (a, m)
    places, before = [], []
    for k in range(a, len(offsets)):
        p = offsets[k][0]
        if p >= high:
            break
        if p > 0 and text[p - 1] in WHITE and (k == 0 or offsets[k - 1][0] < p):
            places.append(p)
            before.append(k)
    return places, before


def _encoded_chunks(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """chunks: key, chunk, n_chunks, text. key, chunk, n_chunks, n, and of the overlaps with the chunk before (head) and
    after (tail) the boundaries' places in the document and the tokens before them."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 16):
                some = batch.slice(s, 16)
                texts, numbers = some.column("text").to_pylist(), some.column("chunk").to_pylist()
                found = tokenizer(path).encode_batch(texts, add_special_tokens=False)
                heads, tails = [], []
                for text, number, e in zip(texts, numbers, found, strict=True):
                    offsets, at = e.offsets, number * chunk
                    for out, low, high in ((heads, 0, overlap), (tails, chunk, chunk + overlap)):
                        places, before = _boundaries(text, offsets, low, high)
                        out.append([{"at": at + p, "before": b} for p, b in zip(places, before, strict=True)])
                kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("key", "chunk", "n_chunks")], pa.array([len(e) for e in found], pa.int64()), pa.array(heads, kind), pa.array(tails, kind)], names=["key", "chunk", "n_chunks", "n", "head", "tail"])

    region = "array<struct<at: long, before: long>>"
    return chunks.mapInArrow(encode, f"key {ROW_KEY}, chunk int, n_chunks int, n long, head {region}, tail {region}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """key, n_tokens (null if a pair of neighbours has no common boundary)."""
    own = Window.partitionBy("key").orderBy("chunk")
    both = encoded.withColumn("next_head", F.lead("head").over(own))
    # the last common boundary; lists are as short as an overlap
    common = F.array_max(F.array_intersect(F.transform("tail", lambda x: x["at"]), F.transform("next_head", lambda x: x["at"])))

    def before(side: str, at: str):
        return F.get(F.filter(side, lambda x: x["at"] == F.col(at)), 0)["before"]

    both = both.withColumn("cut", F.when(F.col("chunk") < F.col("n_chunks") - 1, common)).withColumn("cut_before", F.lag("cut").over(own))
    last, first = F.col("chunk") == F.col("n_chunks") - 1, F.col("chunk") == 0
    left = F.when(first, F.lit(0)).otherwise(before("head", "cut_before"))
    right = F.when(last, F.col("n")).otherwise(before("tail", "cut"))
    # null where a boundary lacks; sum() would pass over it
    parts = both.select("key", (right - left).alias("n"))
    return parts.groupBy("key").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"))


def _cut(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """huge: key, text. key, chunk, n_chunks, text: each text is cut in one pass; the last chunk takes what is over."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for low in range(0, n, 64):
                    parts = [text[k * chunk : None if k == n - 1 else (k + 1) * chunk + overlap] for k in range(low, min(low + 64, n))]
                    numbers = pa.array(range(low, low + len(parts)), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([i] * len(parts))), numbers, pa.array([n] * len(parts), pa.int32()), pa.array(parts)], names=["key", "chunk", "n_chunks", "text"])

    return huge.select("key", "text").mapInArrow(cut, f"key {ROW_KEY}, chunk int, n_chunks int, text string")


def huge_counts(huge: DataFrame, path: str, chunk: int = HUGE, overlap: int = OVERLAP) -> DataFrame:
    """huge: key, text. key, n_tokens.

    A round cuts, encodes and splices what is left; documents with a pair of chunks that share no boundary go to the next round with
    overlaps, and chunks, four times as wide. A chunk that holds its whole document needs no splice, so the rounds end."""
    spark, done = huge.sparkSession, []
    rest = huge
    while True:
        cut = _cut(rest, chunk, overlap).repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "chunk")
        found = stored(_spliced(_encoded_chunks(cut, path, chunk, overlap)), "token_splices")
        done.append(found.filter(F.col("n_tokens").isNotNull()))
        failed = found.filter(F.col("n_tokens").isNull()).select("key")
        if failed.isEmpty():
            break
        rest, chunk, overlap = rest.join(failed, "key", "left_semi"), 4 * chunk, 4 * overlap
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, huge: int = HUGE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens, over_limit, for each row of docs. A null text is empty; a null id stays. Rows that repeat
    are counted each. An empty table gives an empty table. Other columns of docs aren't read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sized = F.octet_length("text").cast("long").alias("n_bytes")
    kind = dict(own.dtypes)["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), BATCH_DOCS):
                some = batch.slice(s, BATCH_DOCS)
                n = pa.array(count_tokens(some.column("text").to_pylist(), path), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    short = own.filter(F.length("text") <= huge).select("doc_id", sized, "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    # texts that repeat share a key and a count
    long = own.filter(F.length("text") > huge).withColumn("key", row_key(F.col("text")))
    once = long.select("key", "text").dropDuplicates(["key"])
    counted = huge_counts(once, path, huge, overlap)
    spliced = long.select("doc_id", sized, "key").join(counted.select("key", "n_tokens"), "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
