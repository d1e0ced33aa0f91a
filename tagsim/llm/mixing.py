"""Mixing sources to target weights: each source's words are packed into fixed-length blocks, every output shard draws its counts of
blocks by source, slots map through a pseudorandom permutation of each source's block numbers, and blocks are joined by number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsim.llm.common import RUN, copy_runs, count_words, documents, each_copy, row_key, spare_name, split_words, stored

#: Weights of the sources in order of code points, repeating; most uses of a source's words.
WEIGHTS = (5, 2, 1)
MAX_USES = 3
#: Words to a block, slots to an output shard.
BLOCK = 256
SHARD = 4096
#: Parts into which each source's documents are dealt before their words are numbered; fixed, so that reruns agree anywhere.
BUCKETS = 4096
#: A mixture names its sources, so there are few. More than this many is an error, not a sample.
MAX_SOURCES = 100_000


def source_targets(sizes: list[int], weights=WEIGHTS, share: float = 1.0, most: float = MAX_USES) -> list[float]:
    """Words to take from each source, sizes in the sources' order. Targets stop at `most` times the source's size; the excess is
    shared by weight among the others until none is above."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    total, caps = share * sum(sizes), [most * x for x in sizes]
    target, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = min(total, float(sum(caps)))
    while free:
        unit = left / sum(w[i] for i in free)
        full = [i for i in free if unit * w[i] > caps[i]]
        if not full:
            for i in free:
                target[i] = unit * w[i]
            break
        for i in full:
            target[i] = float(caps[i])
            left -= caps[i]
        gone = set(full)
        free = [i for i in free if i not in gone]
    return target


def _mixed(*parts: int) -> int:
    """One 63-bit seed of several numbers."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x ^ (p & (2**64 - 1))) * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & (2**64 - 1)
        x ^= x >> 29
    return x >> 1


def shard_counts(slots: np.ndarray, shard: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's count of slots by source, and how many slots each source has in the shards before it.

    Every slot falls to any shard alike, so a source's counts over the shards are multinomial: the range of shards is halved again and
    again, and each source's slots in the left half are a binomial draw, by a seed of the range. Any shard's counts take
    log2(n_shards) draws, on any machine, at any size, and sum up exactly."""
    low, high, own, before = 0, n_shards, slots.astype(np.int64), np.zeros(len(slots), dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng(_mixed(seed, low, high)).binomial(own, (mid - low) / (high - low))
        if shard < mid:
            own, high = left, mid
        else:
            before, own, low = before + left, own - left, mid
    return own, before


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(size), taken at index: a Feistel network on the next power of four, walked until inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_mixed(seed, r)) for r in range(4)]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                f ^= f >> np.uint64(32)
                f = (f * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)
                left, right = right, left ^ (f & mask)
        return (left << np.uint64(half)) | right

    x = network(index.astype(np.uint64))
    while (out := x >= size).any():
        x[out] = network(x[out])
    return x.astype(np.int64)


def source_table(sized: DataFrame, weights=WEIGHTS, block: int = BLOCK, share: float = 1.0) -> list[dict]:
    """sized: source, size, copies. The sources in order of code points, null last, with size, target, n_blocks, n_slots."""
    rows = [(r["source"], int(r["size"])) for r in sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    found = []
    for i, ((source, size), target) in enumerate(zip(rows, source_targets([r[1] for r in rows], weights, share), strict=True)):
        n_blocks = -(-size // block)
        # a block is size / n_blocks words long on average; no block is used more than MAX_USES times
        n_slots = min(MAX_USES * n_blocks, round(target * n_blocks / size)) if size else 0
        found.append({"source_no": i, "source": source, "source_size": size, "target": target, "n_blocks": n_blocks, "n_slots": n_slots})
    return found


def mix_plan(spark: SparkSession, sources: list[dict], seed: int = 0, per_shard: int = SHARD) -> DataFrame:
    """shard, slot, source_no, block, epoch: the block of each slot of each output shard, of which there are per_shard on average. Made in
    parallel by shard; reruns agree."""
    slots = np.array([s["n_slots"] for s in sources], dtype=np.int64)
    blocks = [s["n_blocks"] for s in sources]
    n_shards = max(1, -(-int(slots.sum()) // per_shard))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                count, before = shard_counts(slots, shard, n_shards, seed)
                parts, at = [], 0
                for s in np.flatnonzero(count).tolist():
                    turn = np.arange(before[s], before[s] + count[s])
                    epoch, index = np.divmod(turn, blocks[s])
                    block = np.empty(len(turn), dtype=np.int64)
                    for e in np.unique(epoch).tolist():
                        block[epoch == e] = permuted(index[epoch == e], blocks[s], _mixed(seed, s, e))
                    parts.append(pd.DataFrame({"shard": shard, "slot": np.arange(at, at + len(turn)), "source_no": s, "block": block, "epoch": epoch}))
                    at += len(turn)
                if parts:
                    yield pd.concat(parts, ignore_index=True)

    shards = spark.range(0, n_shards, 1, min(n_shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return shards.mapInPandas(draw, "shard long, slot long, source_no int, block long, epoch long")


def placed_documents(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized: source, size, copies and others. One row for each copy, numbered by `turn` from 0, with source_no, and its first word's
    place `begin` among its source's words.

    The order within a source is (bucket, doc_id, row_key, run), bucket being a hash of the row and its run of copies; a source of any
    size, and a document that repeats any number of times, is spread over the buckets, whose sums are added up by source first."""
    own = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    own = copy_runs(own).withColumn("words", F.col("size") * F.col("copies"))
    own = own.withColumn("bucket", F.pmod(F.pmod(F.col("row_key.a"), F.lit(BUCKETS)) + F.col("run"), F.lit(BUCKETS)).cast("int"))
    sums = own.groupBy("source_no", "bucket").agg(F.sum("words").alias("words"))
    starts = sums.select("source_no", "bucket", (F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("words")).alias("bucket_begin"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "row_key", "run").rowsBetween(Window.unboundedPreceding, 0)
    runs = own.withColumn("within", F.sum("words").over(inside) - F.col("words")).join(starts, ["source_no", "bucket"])
    placed = each_copy(runs).withColumns({"turn": F.col("run") * RUN + F.col("of_run"), "begin": F.col("bucket_begin") + F.col("within") + F.col("of_run") * F.col("size")})
    return placed.drop("bucket_begin", "within", "bucket", "words", "run", "of_run", "copies")


def mix_sizes(own: DataFrame, weights=WEIGHTS, block: int = BLOCK, seed: int = 0, share: float = 1.0, per_shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """own: doc_id, source, row_key, size, copies and others, as a table that reads the same each time. As mix_sources."""
    spark = own.sparkSession
    found = source_table(own, weights, block, share)
    table = spark.createDataFrame([(s["source_no"], s["source"], s["source_size"], s["target"]) for s in found], "source_no int, source string, source_size long, target double")
    plan = mix_plan(spark, found, seed, per_shard)
    # as a table, its size is known: the planner takes what grows out of spark.range() for tiny, and would broadcast it
    uses = stored(plan.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("n")), "mix_uses")
    return placed_documents(own, table), plan, uses


def mix_sources(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, seed: int = 0, share: float = 1.0, per_shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, plan, uses).

    documents: doc_id, row_key, turn, size, source, source_no, source_size, target, begin, for each row of docs; its words are the words
    begin .. begin + size of its source; turn numbers rows that repeat. plan: shard, slot, source_no, block, epoch; block b of a source is its words
    block * b .. block * (b + 1). uses: source_no, block, n, for each block that is used.

    A null text has no words and a source without words has a target of 0; a null source is a source, the last. Rows that repeat
    are documents of their own. An empty table gives empty tables. Other columns of docs aren't read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), row_key(F.col(id_col), F.col(text_col), F.col(source_col)).alias("row_key"), count_words(F.col(text_col)).alias("size"))
    # rows that repeat are one row with their number, so that they don't all meet in one bucket
    own = own.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("copies"))
    return mix_sizes(stored(own, "mix_sizes"), weights, block, seed, share, per_shard)


def document_blocks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each block that a document has words in: the document's columns, block, first and length (words of the document)."""
    spans = placed.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))))
    first = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("begin"), F.col("size"))
    return spans.withColumns({"first": first, "length": last - first})


def mix_texts(docs: DataFrame, seed: int = 0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mixture as documents, with the columns of docs: round r of a document (r from 1 to MAX_USES) holds its words in blocks that
    are used r times or more, joined by a space; a text whose words are all taken stays as it is. Rounds without words are left out,
    and so are null and empty texts.

    Rows are told apart by all their columns, also those of other names, of any names; only rows that are equal in all of them are
    dealt their places by number, whichever of them is which. An empty table gives an empty table."""
    key, turn, spans, rank, picked, copies = (spare_name(docs, f"mix_{x}") for x in ("key", "turn", "spans", "round", "picked", "copies"))
    # a map or a variant can be neither hashed nor grouped by
    plain = [F.to_json(F.struct(c)) if kind.startswith(("map", "variant")) else F.col(c) for c, kind in docs.dtypes]
    keyed = docs.withColumn(key, row_key(*plain))
    # equal rows are one row with their number, which a hot row's partial counts bring together before the shuffle
    numbers = stored(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.first(id_col).alias("id"), F.first(F.col(source_col).cast("string")).alias("source"), F.first(count_words(F.col(text_col))).alias("size")), "mix_rows")
    rows = numbers.select(F.col(key).alias("row_key"), F.col("id").alias("doc_id"), "source", "size", "copies")
    placed, _, uses = mix_sizes(rows, seed=seed, block=block)
    cut = document_blocks(placed, block).join(uses, ["source_no", "block"])
    # a document's spans are bounded by its own length
    taken = cut.groupBy("row_key", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "length", "n"))).alias(spans))
    # equal rows have equal texts: one of each is joined, with the list of its copies' spans cut into rows
    once = keyed.dropDuplicates([key]).join(taken.select(F.col("row_key").alias(key), F.col("turn").alias(turn), spans), key)
    rounds = once.withColumn(rank, F.explode(F.sequence(F.lit(1), F.lit(MAX_USES))))
    rounds = rounds.withColumn(picked, F.filter(spans, lambda s: s["n"] >= F.col(rank))).filter(F.size(picked) > 0)
    words = F.aggregate(picked, F.lit(0).cast("long"), lambda a, s: a + s["length"])
    whole = words == count_words(F.col(text_col))
    text = F.transform(F.array(split_words(F.col(text_col))), lambda w: F.array_join(F.flatten(F.transform(picked, lambda s: F.slice(w, (s["first"] + 1).cast("int"), s["length"].cast("int")))), " "))[0]
    out = rounds.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(text))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(dict(docs.dtypes)[chars_col]))
    return out.select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, uses = mix_sources(documents(spark, sf_dir))
    placed = stored(placed, "mix_documents")
    taken = document_blocks(placed).join(uses, ["source_no", "block"]).groupBy("row_key", "turn").agg(F.sum(F.col("length") * F.col("n")).alias("taken"))
    joined = placed.join(taken, ["row_key", "turn"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
