"""SimHash near-dedup with a wider reach: texts whose sets of word shingles are alike to a given share (Jaccard), by fingerprints of 256 bits.

Sets of similarity s have a cosine of 2 s / (1 + s) at least, so their fingerprints differ in a share p = acos(2 s / (1 + s)) / pi of the
bits, 15% at 0.8, in the mean. The method is that of simhash.py: fingerprints are mapped to bit counts of segments of two bits, and a grid join finds those
whose counts of some segments lie within Manhattan distance 1 beside others that are equal. Counts of any segments differ in sum by no more than the bits do.
No four fixed quarters hold for so many bits, so the grid has more tables, each of which takes a fixed random choice of one word of the fingerprint:
COUNTED segments, and bits that must be equal: a place, where all fingerprints whose counts lie that near meet.
The bits of a table grow with the logarithm of the number of texts, so a fingerprint meets about 32 unrelated
texts at any size. How many bits of a word differ is spread around its mean, and a pair with many is missed by more tables; the number of tables is worked
out from that distribution, so that a pair of just the similarity is missed by all in 3 of 100 cases at any size. They grow as the
power 0.3 of the texts. Candidates go on by another word's Hamming distance, by that of all bits and by the sets' sizes; the shingles of both
texts decide. So no link is wrong; of the pairs of just the similarity 3 in a hundred are missed, of closer ones hardly any."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsim.llm.common import ROW_KEY, emptied, row_key, spare_name, stored
from tagsim.llm.components import components

SIZE, SIMILARITY = 5, 0.8
SEED = 42
WORDS = 4
#: Share of pairs at the similarity that all tables of the grid may miss.
MISS = 0.03
#: Unrelated texts that a fingerprint meets in a table: 2 to this power.
SPARE_BITS = 5
#: Texts of a cell of more rows than this, and than a cell has of unrelated texts, are handled by pivots and rare shingles.
CROWDED = 16
#: Parities of a set of shingles.
ODD_BITS = 512
#: Rows of a table of long keys that may be sent to every executor once it has been counted.
MAX_BROADCAST = 1_000_000
#: Segments of two bits of a table whose counts may lie one apart in all. Counts of unrelated texts do so in one of eight cases, as three equal bits.
COUNTED, COUNTED_BITS = 4, 3
#: Increments of the hashes of the fingerprint's second, third and fourth word.
STEP = 0x9E3779B97F4A7C15
#: Rows whose bits are added up in bytes.
BYTE_ROWS = 240


def shingle_hashes(text: str | None, size: int = SIZE) -> tuple[bytes, np.ndarray]:
    """The words joined by spaces, and the different hashes of their shingles, ascending. Only A-Z are lower-cased; a text of fewer words is
    one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        shingles = iter([b" ".join(words)] if words else [])
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    return b" ".join(words), np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four unsigned integers: a bit is 1 if set in over half the hashes, and as the least hash has it if in just half."""
    if not len(hashes):
        return np.zeros(WORDS, dtype=np.uint64)
    ones, least = np.zeros(64 * WORDS, dtype=np.int64), None
    for start in range(0, len(hashes), BYTE_ROWS << 6):
        part = hashes[start : start + (BYTE_ROWS << 6)]
        wide = np.stack([part, *(_mixed(part + np.uint64(STEP * w & (1 << 64) - 1)) for w in range(1, WORDS))], axis=1)
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        least = bits[0] if least is None else least
        ones += np.add.reduceat(bits, np.arange(0, len(part), BYTE_ROWS), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits((2 * ones > len(hashes)) | ((2 * ones == len(hashes)) & (least == 1)), bitorder="little").view(np.uint64)


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, row_key, node (128 bits of the words, alike for equal sequences), n (different shingles), f0 to f3, for each row."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ns, fps = [], [], np.zeros((batch.num_rows, WORDS), dtype=np.uint64)
            for i, t in enumerate(batch.column(2)):
                words, hashes = shingle_hashes(t.as_py(), size)
                nodes.append(xxhash.xxh3_128_digest(words))
                ns.append(len(hashes))
                fps[i] = wide_fingerprint(hashes)
            signed = [pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(ns, pa.int64()), *signed],
                                             names=["doc_id", "row_key", "node", "n", *(f"f{w}" for w in range(WORDS))])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(of, f"doc_id long, row_key {ROW_KEY}, node binary, n long, f0 long, f1 long, f2 long, f3 long")


def _shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """texts: node, text. node, hashes (array of long)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = shingle_hashes(batch.column(1)[i].as_py(), size)[1].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([hashes], pa.list_(pa.int64()))], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(of, "node binary, hashes array<long>")


def differing_share(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def missed_share(bits: int, per_word: list[int], differing: float) -> float:
    """The share of pairs that all tables miss: `per_word` tables for each word of 64 bits, each of which differs in a share `differing` of pairs; a table
    asks for `bits` equal bits, and for counts of COUNTED segments within Manhattan distance 1."""
    spread = [math.comb(64, d) * differing**d * (1 - differing) ** (64 - d) for d in range(65)]
    # ways to lie that near with j differing bits: segments that differ in both keep their counts in half the cases; one bit more may differ in another
    ways = [0.0] * (2 * COUNTED + 1)
    for both in range(COUNTED + 1):
        ways[2 * both] += math.comb(COUNTED, both) / 2**both
        if both < COUNTED:
            ways[2 * both + 1] += math.comb(COUNTED, both) / 2**both * 2 * (COUNTED - both)
    other = 64 - bits - 2 * COUNTED
    agree = [sum(w * math.comb(other, d - j) for j, w in enumerate(ways) if j <= d) / math.comb(64, d) for d in range(65)]
    return math.prod(sum(s * (1 - a) ** n for s, a in zip(spread, agree, strict=True)) for n in per_word)


class Table(NamedTuple):
    """Of the grid: a word of the fingerprint, the mask (as a signed long) of its bits that must be equal, those of the segments whose bits are counted."""

    word: int
    mask: int
    segments: tuple[int, ...]


def crowded_rows(n: int, grid: list[Table]) -> int:
    """Rows of a cell up to which unrelated texts alone may lie in it: those of a cell where each counted segment has one bit set, the likeliest
    counts by far (1 of 16), hold 8 to 16 of n texts in the mean."""
    mean = n / 2 ** ((grid[0].mask & (1 << 64) - 1).bit_count() + COUNTED)
    return max(CROWDED, math.ceil(mean + 6 * math.sqrt(mean)))


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def count_grid(n: int, similarity: float) -> list[Table]:
    """The grid's tables for n texts."""
    k = min(64 - 2 * COUNTED, max(8, math.ceil(math.log2(max(n, 2))) - SPARE_BITS) - COUNTED_BITS)
    draw = random.Random(SEED)
    count, p = WORDS, differing_share(similarity)
    while missed_share(k, [len(range(w, count, WORDS)) for w in range(WORDS)], p) > MISS:
        count = math.ceil(count * 1.02)
    drawn = [draw.sample(range(64), k + 2 * COUNTED) for _ in range(count)]
    return [Table(t % WORDS, _mask(d[:k]), tuple(_mask(d[i : i + 2]) for i in range(k, len(d), 2))) for t, d in enumerate(drawn)]


def tables(n: int, similarity: float) -> list[tuple[int, int]]:
    """(word, mask of the equal bits) of each table of the grid for n texts."""
    return [(t.word, t.mask) for t in count_grid(n, similarity)]


def _cells(items: DataFrame, grid: list[Table], *also: str) -> DataFrame:
    """node, also, place (a table and its equal bits), counts (of its segments, in fields of two bits), check (another word of the fingerprint): one row for each item and table."""
    cells = []
    for t, (w, mask, segments) in enumerate(grid):
        counts = sum((F.bit_count(F.col(f"f{w}").bitwiseAND(F.lit(m))) * (1 << 2 * i) for i, m in enumerate(segments)), F.lit(0))
        cells.append(F.struct(F.xxhash64(F.lit(t), F.col(f"f{w}").bitwiseAND(F.lit(mask))).alias("place"), counts.alias("counts"), F.col(f"f{(w + 1) % WORDS}").alias("check")))
    placed = items.select("node", *also, F.explode(F.array(*cells)).alias("c")).select("node", *also, "c.place", "c.counts", "c.check")
    return placed.withColumn("cell", F.xxhash64("place", "counts"))


def _looked(homes: DataFrame) -> DataFrame:
    """homes with a row for the own cell (step 0) and for each cell one step up."""
    steps = [F.when(F.shiftright("counts", 2 * i).bitwiseAND(F.lit(3)) < 2, F.lit(1 << 2 * i)) for i in range(COUNTED)]
    rows = homes.withColumn("step", F.explode(F.array_compact(F.array(F.lit(0), *steps))))
    return rows.withColumn("cell", F.xxhash64("place", F.col("counts") + F.col("step")))


def _ladder(counts: Column) -> Column:
    """counts with 0, 1, 2 as 00, 01, 11: the bits that differ are the Manhattan distance. What `_looked` joins by cells meets at one place, in a row for each item and table."""
    return counts.bitwiseOR(F.shiftright(counts, 1).bitwiseAND(F.lit(sum(1 << 2 * i for i in range(COUNTED)))))


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def crowded_pairs(sets: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """sets: node, hashes (different, ascending); parts: node, component. Pairs (a, b), each once, of nodes that aren't of one component, among which
    are all that are similar.

    Similar sets share one of the rarest of each: those left when a share `similarity` of a set is taken away, and one more. Texts of
    a large group that are less alike differ in just their rare shingles, so few meet, and pairs of a shingle's largest component are not formed. Of those
    that meet, parities tell most that are not similar: a set's shingles are dealt to ODD_BITS places, and a bit says whether a place has an odd number; sets differ in as many
    shingles at least as their bits do."""
    asked = stored(sets.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("shingle")), "similar_shingles")
    # what one set alone has comes first and meets nothing
    shared = stored(asked.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "similar_shared")
    of_node = Window.partitionBy("node")
    ranked = asked.join(shared, "shingle").withColumn("own", F.col("n") - F.count(F.lit(1)).over(of_node)).withColumn("place", F.col("own") + F.row_number().over(of_node.orderBy("rows", "shingle")))
    rarest = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    rare = ranked.filter(F.col("place") <= rarest).select("node", "n", "shingle", F.col("place").cast("int").alias("place"))
    word, bit = F.shiftrightunsigned("shingle", 6).bitwiseAND(F.lit(ODD_BITS // 64 - 1)), F.expr("shiftleft(1L, int(shingle & 63))")
    odd = stored(asked.groupBy("node").agg(F.array(*(F.bit_xor(F.when(word == w, bit).otherwise(0)) for w in range(ODD_BITS // 64))).alias("odd")), "similar_odd")
    rare = rare.join(odd, "node")
    rare = stored(rare.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")), "similar_rare")
    largest = rare.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("rows")).groupBy("shingle").agg(F.max_by("part", F.struct("rows", "part")).alias("part"))
    largest = stored(largest, "similar_largest")
    main = stored(rare.join(largest, ["shingle", "part"], "left_semi"), "similar_main")
    rest = stored(rare.join(largest, ["shingle", "part"], "left_anti"), "similar_rest")
    emptied(asked, rare)

    def ends(df: DataFrame, end: str) -> DataFrame:
        return df.select("shingle", F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "part", "place", "odd")))

    # at the first shingle that two similar sets share, what is left of either from there on is enough to be similar
    both, left = F.col("n_a") + F.col("n_b"), F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    differing = sum((F.bit_count(F.col("odd_a")[w].bitwiseXOR(F.col("odd_b")[w])) for w in range(ODD_BITS // 64)), F.lit(0))
    able = (F.col("part_a") != F.col("part_b")) & (left * (1 + similarity) >= both * similarity - 1e-6) & (differing * (1 + similarity) <= both * (1 - similarity) + 1e-6)
    one = ends(rest, "a").join(ends(rest, "b"), "shingle").filter(able & (F.col("a") > F.col("b"))).select("a", "b")
    two = ends(rest, "a").join(ends(main, "b"), "shingle").filter(able).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return one.unionByName(two).distinct()


def similar_links(items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, size: int = SIZE) -> DataFrame:
    """items: node, n, f0 to f3, each node once; texts_of: from a table of nodes to node, text, for those nodes. Links (a, b) of similar texts that
    join the same texts as all pairs that share a cell do.

    Texts of cells of many rows, where a large group of near copies lies, are compared with four pivots of the cell first; the pivots are least
    or greatest by hashes that hold for all cells, so a group has few. Among each other such texts then meet by their rare shingles (`crowded_pairs`),
    which leaves out none that are similar, instead of in cells."""
    if not 0 < similarity < 1:
        raise ValueError("similarity must lie between 0 and 1")
    p = differing_share(similarity)
    most = [math.ceil(bits * p + 3.5 * math.sqrt(bits * p * (1 - p))) for bits in (64, 64 * WORDS)]
    # different sets of fewer shingles are less alike
    items = items.filter(F.col("n") * (1 - similarity) >= similarity - 1e-9)
    n = items.count()
    grid = count_grid(n, similarity)

    def near(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b; repeats allowed), each once, that fit by all bits."""
        pairs = pairs.distinct()
        for end in ("a", "b"):
            pairs = pairs.join(items.select(F.col("node").alias(end), *(F.col(f"f{w}").alias(f"{end}{w}") for w in range(WORDS))), end)
        return pairs.filter(sum((_far(f"a{w}", f"b{w}") for w in range(1, WORDS)), _far("a0", "b0")) <= most[1]).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose sets of shingles are similar."""
        pairs = stored(pairs, "similar_candidates")
        nodes = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "similar_nodes")
        sets = stored(_shingle_sets(texts_of(nodes), size), "similar_sets")
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("hashes").alias(f"h_{end}")), end)
        both = F.size(F.array_intersect("h_a", "h_b"))
        return pairs.filter(both >= (F.size("h_a") + F.size("h_b") - both) * similarity).select("a", "b")

    def sized(a: str, b: str) -> Column:
        return F.least(a, b) >= F.greatest(a, b) * similarity

    homes = stored(_cells(items, grid, "n"), "similar_homes")
    hot = stored(homes.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > crowded_rows(n, grid)), "similar_hot")
    in_hot = stored(homes.join(hot, "cell", "left_semi"), "similar_in_hot")
    pivot = [F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node", "n", "check") for k in range(2)]
    pivots = stored(in_hot.groupBy("cell").agg(F.array_distinct(F.array(F.min(pivot[0]), F.max(pivot[0]), F.min(pivot[1]), F.max(pivot[1]))).alias("p")), "similar_pivots")
    first = in_hot.join(pivots, "cell").select("node", "n", "check", F.explode("p").alias("p")).filter((F.col("node") != F.col("p.node")) & sized("n", "p.n") & (_far("check", "p.check") <= most[0]))
    first = stored(verified(near(first.select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b")))), "similar_pivot_links")
    crowded = stored(in_hot.select("node").distinct(), "similar_crowded")
    sets = stored(_shingle_sets(texts_of(crowded), size), "similar_crowded_sets")
    among = crowded_pairs(sets, components(first, "similar_parts"), similarity)

    emptied(homes, in_hot)
    marked = items.join(crowded.withColumn("is_crowded", F.lit(True)), "node", "left").withColumn("is_crowded", F.col("is_crowded").isNotNull())
    marked = stored(marked.select("node", "n", "is_crowded", *(f"f{w}" for w in range(WORDS))), "similar_marked")

    def ends(df: DataFrame, end: str) -> DataFrame:
        return _cells(df, grid, "n", "is_crowded").select("place", F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "check", "is_crowded")), _ladder(F.col("counts")).alias(f"ladder_{end}"))

    # crowded texts meet each other by their shingles alone, so no more than a few texts of each cell of a place meet the others of that place
    close = (F.col("is_crowded_a") | (F.col("a") > F.col("b"))) & (_far("ladder_a", "ladder_b") <= 1) & (_far("check_a", "check_b") <= most[0]) & sized("n_a", "n_b")
    met = ends(marked, "a").join(ends(marked.filter("NOT is_crowded"), "b"), "place").filter(close)
    found = near(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    found = stored(verified(found.unionByName(among)), "similar_links")
    emptied(sets, marked)
    return first.unionByName(found)


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, row_key, component_id, group_key, kept, for each row of docs.

    Rows of one sequence of words are one text; texts link when their sets of shingles of `size` words have a similarity of `similarity` or
    more. component_id is the least doc_id that links reach, null if there is none; group_key is never null: the kept row's row_key. kept: the row, or
    rows that repeat it, with the component's least (doc_id, row_key), null last. Null texts and texts without words are one
    group. An empty table gives an empty table. Other columns of docs aren't read."""
    own = stored(_fingerprints(docs, id_col, text_col, size), "similar_fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    words = [F.first(c).alias(c) for c in ("n", "f0", "f1", "f2", "f3")]
    items = stored(own.groupBy("node").agg(F.min(place).alias("least"), *words), "similar_items")

    def texts_of(nodes: DataFrame) -> DataFrame:
        asked = stored(items.select("node", F.col("least.row_key").alias("row_key")).join(nodes, "node"), "similar_asked")
        keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
        # other texts are left where they are
        halves = asked.select(F.col("row_key.a").alias("half")).distinct()
        keyed = keyed.join(F.broadcast(halves), F.col("row_key.a") == F.col("half"), "left_semi") if asked.count() <= MAX_BROADCAST else keyed
        return keyed.join(asked, "row_key").dropDuplicates(["node"])

    links = similar_links(items.drop("least"), texts_of, similarity, size)
    parts = components(links, "similar_components")
    named = items.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("least").alias("first"))
    named = named.join(least, "part").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("group_key"))
    return own.join(named, "node").select("doc_id", "row_key", "component_id", "group_key", (F.col("row_key") == F.col("group_key")).alias("kept"))


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """docs with one row of each group of similar_groups: its least doc_id, null last; rows that repeat it in id and text go too, whichever
    other columns they have. Null texts and texts without words are one group. An empty table gives an empty table. Columns of docs may have any names."""
    key = spare_name(docs, "key")
    kept = similar_groups(docs, similarity, id_col, text_col, size).filter("kept").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(F.col(id_col), F.col(text_col))).join(kept, key).dropDuplicates([key]).select(*docs.columns)
