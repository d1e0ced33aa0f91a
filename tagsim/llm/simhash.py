"""SimHash near-dedup: fingerprints of word shingles, mapped to bit counts of short segments; a grid join under Manhattan distance finds
the fingerprints that can be near, the Hamming distance decides.

The bit counts of any segments differ in sum by no more than the bits do. With 32 segments of two bits, two fingerprints that differ
in at most 3 bits have counts within Manhattan distance 3, so in one half of the segments within distance 1, and then in one quarter of
that half not a single bit differs. The grid's cells are such a quarter's bits with the counts of the half's other quarter, in four
ways; a fingerprint looks into its own cells and into those one step up, which meets each such pair once or a few times and leaves
about one candidate in 3.5 million pairs of unrelated fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.llm.common import ROW_KEY, documents, row_key, spare_name, stored
from tagsim.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Shingles of a document whose bits are counted at once.
CHUNK = 1 << 15
#: The lower bit of each segment of a quarter.
LOW_BITS = 0x5555
PIVOTS = 4


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits as an unsigned integer. Only A-Z are lower-cased; words are separated by ASCII white space."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False)) if len(words) >= size else iter([b" ".join(words)])
    total, digest, ones = max(1, len(words) - size + 1), xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        h = np.fromiter((digest(s, SEED) for _, s in zip(range(n), shingles)), dtype=np.uint64, count=n)
        ones += np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, row_key, fp (the 64 bits as a signed long), for each row of docs."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "row_key", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(of, f"doc_id long, row_key {ROW_KEY}, fp long")


def _cells(fps: DataFrame, *also: str) -> DataFrame:
    """fp, cell, home, also: the four cells that a fingerprint lies in (home), and those one step up (not home). A cell is a long: which
    quarter, its 16 bits, and the other quarter's eight counts in fields of two bits."""
    quarter = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    cells = []
    for k in range(4):
        other = quarter[k ^ 1]
        counts = other.bitwiseAND(F.lit(LOW_BITS)) + F.shiftrightunsigned(other, 1).bitwiseAND(F.lit(LOW_BITS))
        cell = F.lit(k << 32) + F.shiftleft(quarter[k], 16) + counts
        cells.append(F.struct(cell.alias("cell"), F.lit(True).alias("home")))
        for i in range(8):
            step = F.when(F.shiftright(counts, 2 * i).bitwiseAND(F.lit(3)) < 2, cell + (1 << (2 * i)))
            cells.append(F.struct(step.alias("cell"), F.lit(False).alias("home")))
    placed = fps.select("fp", *also, F.explode(F.array(*cells)).alias("c"))
    return placed.filter(F.col("c.cell").isNotNull()).select("fp", *also, F.col("c.cell").alias("cell"), F.col("c.home").alias("home"))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fps: fp, each once. Links (a, b) with at most 3 differing bits that join the same fingerprints, directly or by way of others,
    as all such pairs do.

    First every fingerprint of a cell is compared with a few pivots of the cell: the links grow with the fingerprints, not with the
    pairs of a large group of near copies. Then only cells that still hold more than one component are joined, and there the largest
    component's own pairs are never formed, so no pair that could join two components is left out."""
    if max_bits > 3:
        raise ValueError("the grid holds for at most 3 bits")

    def near(a: str, b: str) -> Column:
        return (F.col(a) != F.col(b)) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits)

    members = _cells(fps)
    spread = F.xxhash64("fp")
    lived = F.when(F.col("home"), F.col("fp"))
    pivots = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(lived).alias("p0"), F.max(lived).alias("p1"), F.min_by(lived, F.when(F.col("home"), spread)).alias("p2"), F.max_by(lived, F.when(F.col("home"), spread)).alias("p3"))
    # as tables, here and below, so that a join on cell can be split where a cell is hot
    pivots = stored(pivots.filter((F.col("n") > 1) & F.col("p0").isNotNull()), "simhash_pivots")
    first = members.select("fp", "cell").join(pivots, "cell").select("fp", F.explode(F.array_distinct(F.array("p0", "p1", "p2", "p3"))).alias("p"))
    first = stored(first.filter(near("fp", "p")).select(F.greatest("fp", "p").alias("a"), F.least("fp", "p").alias("b")).distinct(), "simhash_pivot_links")
    grouped = components(first, "simhash_components")
    labelled = stored(fps.join(grouped, fps["fp"] == grouped["node"], "left").select("fp", F.coalesce("component", "fp").alias("part")), "simhash_parts")
    members = _cells(labelled, "part")
    mixed = members.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("home").alias("lived")).filter("low < high AND lived").select("cell")
    inside = stored(members.join(stored(mixed, "simhash_mixed_cells"), "cell"), "simhash_mixed")
    sizes = inside.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = stored(sizes.groupBy("cell").agg(F.max_by("part", F.struct("n", "part")).alias("largest")), "simhash_largest")
    inside = stored(inside.join(largest, "cell").withColumn("main", F.col("part") == F.col("largest")).drop("largest"), "simhash_mixed")
    left = inside.select("cell", F.col("fp").alias("a"), F.col("part").alias("part_a"), F.col("main").alias("main_a"))
    right = inside.filter("home").select("cell", F.col("fp").alias("b"), F.col("part").alias("part_b"), F.col("main").alias("main_b"))
    # two of different components are not both in the largest
    pairs = left.join(right.filter("NOT main_b"), "cell").unionByName(left.filter("NOT main_a").join(right.filter("main_b"), "cell"))
    return first.unionByName(pairs.filter((F.col("part_a") != F.col("part_b")) & near("a", "b")).select("a", "b"))


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, row_key, fp (signed long), component_id, group_key, kept, for each row of docs.

    Words are those between ASCII white space; shingles of `size` words count as often as they occur; a text with fewer words is one
    shingle and a text without words, or null, has fingerprint 0, which links like any other. Rows with one fingerprint are handled as
    one. component_id is the least doc_id that links reach; rows with a null id link too, but name a component only if it has no other
    id (then it is null). group_key: one for each component, never null, the kept row's row_key. kept: the row, or rows that repeat it, with the component's least (doc_id, row_key), null last. Rows that
    repeat stay and share all values. An empty table gives an empty table. Other columns of docs aren't read."""
    own = stored(fingerprints(docs, id_col, text_col, size), "simhash_fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    groups = stored(own.groupBy("fp").agg(F.min(place).alias("least")), "simhash_groups")
    parts = components(near_links(groups.select("fp"), max_bits), "simhash_components")
    labelled = groups.join(parts, groups["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    least = labelled.groupBy("part").agg(F.min("least").alias("first"))
    named = labelled.join(least, "part").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("group_key"))
    return own.join(named, "fp").select("doc_id", "row_key", "fp", "component_id", "group_key", (F.col("row_key") == F.col("group_key")).alias("kept"))


def drop_near_copies(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: its least doc_id, null last; rows that repeat it in id and text go too, whichever other columns
    they have. Null and empty texts are one group, of which one row stays. An empty table gives an empty table. Columns of docs may
    have any names."""
    key = spare_name(docs, "key")
    kept = simhash_groups(docs, max_bits, id_col, text_col).filter("kept").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(F.col(id_col), F.col(text_col))).join(kept, key).dropDuplicates([key]).select(*docs.columns)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", "kept")
