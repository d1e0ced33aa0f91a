"""Substring dedup: every window of 20 words that has occurred before loses its words, found in a De Bruijn graph of the corpus.

Nodes are runs of K - 1 words, edges the windows of K words, each from its first to its last K - 1 words. Consecutive edges of a document
whose least hash of M words (the anchor) lies at one place are one path; equal windows have equal anchors, so a window repeats
only among paths of one anchor.

    1. Anchors that occur once are counted away. A filter of bounded size lets few of their paths out of the later passes over the
       texts, and a join drops the rest.
    2. Equal paths are one edge of the graph, of several windows, if their anchor has no other path. Where an anchor's paths differ, the
       first of each different path is taken apart into its windows, and windows that occur again are edges of their own.
    3. Nodes get their in- and out-degrees. Edges that meet at a node of degree one in and one out, side by side in the source, are
       compacted by a join into one unitig; repeats of a unitig are one span.
    4. Spans have their source's coordinates, and each span's words are held against its source's. If any differ (equal hashes of
       different words), all is done again with other hashes.

Hashes are sums of random numbers times powers of an odd base, in 64 bits, worked out for many documents at once; paths are compared by
two of different base, windows by one and half of another."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsim.llm.common import SPACE, documents, emptied, stored

#: Words of a window; words of an anchor. An anchor has PLACES places in a window.
WINDOW = 20
ANCHOR = 6
PLACES = WINDOW - ANCHOR + 1
#: Words that are hashed at once. A longer document's path ends at this border, which only means that its anchor may be taken apart.
CHUNK = 1 << 16
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
#: Bits of a filter at most (32 MB), whatever the input's size, and for each key below that. A fuller filter lets more paths pass, which
#: the join behind it drops.
MAX_FILTER_BITS = 1 << 28
FILTER_BITS = 16

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in SPACE]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class Sums:
    """Rolling sums of one odd base: for items x_0, x_1, ... of a run the sum of x_i * base^-i, modulo 2^64, times base^length."""

    def __init__(self, base: int):
        self._base, self.up, self.down = base | 1, np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def prefix(self, items: np.ndarray) -> np.ndarray:
        if len(items) + 1 > len(self.up):
            size, inverse = max(CHUNK, len(items)) + 64, pow(self._base, -1, 2**64)
            one = np.ones(1, dtype=np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(size, self._base, dtype=np.uint64), dtype=np.uint64)])
            self.down = np.concatenate([one, np.cumprod(np.full(size, inverse, dtype=np.uint64), dtype=np.uint64)])
        out = np.zeros(len(items) + 1, dtype=np.uint64)
        np.cumsum(items * self.down[: len(items)], dtype=np.uint64, out=out[1:])
        return out

    def between(self, prefix: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((prefix[end] - prefix[first]) * self.up[first])


@dataclass
class Paths:
    """Of the documents of a batch: for each path its document's row, first window, number of windows, anchor, hash of its words, and the
    nodes at its ends."""

    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    words: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def at(self) -> np.ndarray:
        return self.first * 16 + self.count - 1


class Hasher:
    """The hashes of one seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self._bytes = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self._letters, self.one, self.two = (Sums(int(b)) for b in rng.integers(0, 2**64, 3, dtype=np.uint64))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and where each text's begin (one more entry at the end)."""
        offsets = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        space = _SPACE[data]
        edge = np.ones(len(data) + 1, dtype=bool)  # whether a word can't go on from the byte before
        edge[1:-1] = space[:-1]
        edge[offsets] = True
        inside = ~space
        start, end = np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & (edge[1:] | np.append(space[1:], True))) + 1
        out, k = np.empty(len(start), dtype=np.uint64), 0
        while k < len(start):
            low = int(start[k])
            upto = max(k + 1, int(np.searchsorted(end, low + PIECE, side="right")))
            prefix = self._letters.prefix(self._bytes[data[low : int(end[upto - 1])]])
            out[k:upto] = self._letters.between(prefix, start[k:upto] - low, end[k:upto] - low)
            k = upto
        return out + (end - start).astype(np.uint64), np.searchsorted(start, offsets)

    def _parts(self, begin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(first row, end row, first word, end word) of whole texts of about CHUNK words together, or parts of one longer text."""
        row, n = 0, len(begin) - 1
        while row < n:
            upto = max(row + 1, int(np.searchsorted(begin, begin[row] + CHUNK, side="right")) - 1)
            low, high = int(begin[row]), int(begin[upto])
            if high - low <= CHUNK:
                yield row, upto, low, high
            else:
                for at in range(low, max(low + 1, high - WINDOW + 1), CHUNK):
                    yield row, upto, at, min(high, at + CHUNK + WINDOW - 1)
            row = upto

    def paths(self, hashes: np.ndarray, begin: np.ndarray, choose=None) -> Iterator[tuple[Paths, dict | None]]:
        """The paths of each part; and, of those for which choose(paths) is true, the windows: path (its number), place in the document, two
        hashes, and nodes."""
        for row, upto, low, high in self._parts(begin):
            own = hashes[low:high]
            n = len(own) - WINDOW + 1
            if n < 1:
                continue
            p1, p2 = self.one.prefix(own), self.two.prefix(own)
            at = np.arange(len(own) - ANCHOR + 1)
            small = self.one.between(p1, at, at + ANCHOR)
            least = np.minimum(small[:-1], small[1:])
            least = np.minimum(least[:-2], least[2:])
            least = np.minimum(least[:-4], least[4:])
            least = np.minimum(least[: n], least[PLACES - 8 : PLACES - 8 + n])
            inside = np.diff(np.append(np.clip(begin[row : upto + 1], low, high)[:-1], high))
            rows = np.repeat(np.arange(row, upto), inside)
            ends = np.repeat(np.clip(begin[row + 1 : upto + 1], low, high) - low, inside)
            window = np.flatnonzero(np.arange(n) + WINDOW <= ends[:n])
            if not len(window):
                continue
            # a path ends where the next window is another text's, has another anchor, or loses the place of the anchor
            before = window[1:] - 1
            new = (window[:-1] != before) | (least[window[1:]] != least[before]) | (small[before] == least[before])
            first = window[np.flatnonzero(np.concatenate([[True], new]))]
            count = np.diff(np.append(np.flatnonzero(np.concatenate([[True], new])), len(window)))
            of = rows[first]
            found = Paths(of, first + low - begin[of], count, least[first], self.two.between(p2, first, first + count + WINDOW - 1) + count.astype(np.uint64), self.two.between(p2, first, first + WINDOW - 1), self.two.between(p2, first + count, first + count + WINDOW - 1))
            windows = None
            if choose is not None:
                path = np.flatnonzero(choose(found))
                k = np.repeat(path, count[path])
                w = np.arange(len(k)) - np.repeat(np.cumsum(count[path]) - count[path], count[path]) + first[k]
                windows = {"path": k, "place": found.first[k] + w - first[k], "h": self.one.between(p1, w, w + WINDOW), "h2": self.two.between(p2, w, w + WINDOW), "left": self.two.between(p2, w, w + WINDOW - 1), "right": self.two.between(p2, w + 1, w + WINDOW)}
            yield found, windows


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.itemsize == 8 else c.view(np.int32)) for c in columns.values()], names=list(columns))


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


#: Texts of a batch that are hashed together.
BATCH_DOCS = 512


def _scanned(docs: DataFrame, seed: int, give, schema: str, choose=None) -> DataFrame:
    """docs: doc, text. give(doc numbers, paths, windows) of every part of every batch."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        for batch in batches:
            for s in range(0, len(batch), BATCH_DOCS):
                some = batch.slice(s, BATCH_DOCS)
                doc = some.column("doc").to_numpy()
                pick = None if choose is None else lambda paths: choose(doc[paths.row], paths)  # noqa: B023
                for paths, windows in hasher.paths(*hasher.words(some.column("text")), pick):
                    yield give(doc, paths, windows)

    return docs.select("doc", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(of, schema)


def _place_key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.view(np.uint64))


def bit_filter(keys: DataFrame, of) -> tuple:
    """A filter of the rows of keys: a broadcast array of bits, at most MAX_FILTER_BITS, and its number of bits. of(batch) gives the rows'
    64-bit hashes. The bits are put together by Spark in parts; the driver sees only the whole filter, never keys."""
    spark, n_bits = keys.sparkSession, 1 << 16
    while n_bits < MAX_FILTER_BITS and n_bits < FILTER_BITS * keys.count():
        n_bits *= 2
    n_parts, size = 16, n_bits // 16 // 64

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique((of(batch) % np.uint64(n_bits)).astype(np.int64))
            word, first = np.unique(bit >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)), first) if len(word) else np.empty(0, dtype=np.uint64)
            yield _batch(word=word, value=value)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = np.zeros(size, dtype=np.uint64), None
        for batch in batches:
            word = batch.column("word").to_numpy()
            if len(word):
                part = int(word[0]) // size
                np.bitwise_or.at(own, word % size, batch.column("value").to_numpy().view(np.uint64))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "bits"])

    found = keys.mapInArrow(words, "word long, value long").repartitionById(n_parts, F.expr(f"int(word div {size})")).mapInArrow(parts, "part int, bits binary").collect()
    by = {r["part"]: bytes(r["bits"]) for r in found}
    return spark.sparkContext.broadcast(b"".join(by.get(k, bytes(8 * size)) for k in range(n_parts))), n_bits


def _passes(bits, n_bits: int, hashes: np.ndarray) -> np.ndarray:
    words, bit = np.frombuffer(bits.value, "<u8"), hashes % np.uint64(n_bits)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def repeated_paths(docs: DataFrame, seed: int) -> DataFrame:
    """anchor, words, node_a, node_b, doc, at (first window * 16 + windows - 1) of the paths whose anchor occurs twice or more."""
    found = _scanned(docs, seed, lambda doc, p, w: _batch(anchor=p.anchor), "anchor long")
    # as a table: only a join of two plain exchanges is split where a key is hot, not one with an aggregate on its way
    anchors = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "substring_anchors")
    bits, n_bits = bit_filter(anchors, lambda batch: _mixed(batch.column("anchor").to_numpy().view(np.uint64)))

    def give(doc: np.ndarray, p: Paths, _) -> pa.RecordBatch:
        ok = _passes(bits, n_bits, _mixed(p.anchor))
        return _batch(anchor=p.anchor[ok], words=p.words[ok], node_a=_short(p.left[ok]), node_b=_short(p.right[ok]), doc=doc[p.row[ok]], at=p.at()[ok])

    passed = _scanned(docs, seed, give, "anchor long, words long, node_a int, node_b int, doc long, at long")
    out = stored(passed.join(anchors, "anchor"), "substring_paths")
    emptied(anchors)
    return out


def repeated_windows(docs: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """wanted: doc, at. h, h2, node_a, node_b, doc, place of the windows of these paths, and of a few others, which do no harm: any window is
    one of the corpus."""
    bits, n_bits = bit_filter(wanted, lambda batch: _place_key(batch.column("doc").to_numpy(), batch.column("at").to_numpy()))

    def give(doc: np.ndarray, p: Paths, w: dict) -> pa.RecordBatch:
        return _batch(h=w["h"], h2=_short(w["h2"]), node_a=_short(w["left"]), node_b=_short(w["right"]), doc=doc[p.row[w["path"]]], place=w["place"])

    out = _scanned(docs, seed, give, "h long, h2 int, node_a int, node_b int, doc long, place long", lambda doc, p: _passes(bits, n_bits, _place_key(doc, p.at())))
    return stored(out, "substring_windows")


def unitigs(edges: DataFrame) -> DataFrame:
    """edges: node_a, node_b, doc, first, count (each edge once, with its source). doc, first, count, unitig: the source's first window of the
    unitig that the edge is compacted into.

    A node is told by 32 bits: as edges are compacted only side by side in one source, nodes that share them merely end a unitig early.
    A node's in-degree counts the edges that end there, its out-degree those that begin; where both are one, the edge that ends there is the
    only one, and is told by the sums. Unitigs are numbered along their source, whose edges are bounded by its length."""
    end = F.col("first") + F.col("count")
    ends = edges.select(F.col("node_b").alias("node"), F.lit(1).alias("n_in"), F.lit(0).alias("n_out"), F.col("doc").alias("from_doc"), end.alias("from_end"))
    begins = edges.select(F.col("node_a").alias("node"), F.lit(0), F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("long"))
    nodes = ends.union(begins).groupBy("node").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.max("from_doc").alias("from_doc"), F.max("from_end").alias("from_end"))
    plain = stored(nodes.filter("n_in = 1 AND n_out = 1").select(F.col("node").alias("node_a"), "from_doc", "from_end"), "substring_nodes")
    joined = edges.join(plain, "node_a", "left")
    goes_on = F.coalesce((F.col("from_doc") == F.col("doc")) & (F.col("from_end") == F.col("first")), F.lit(False))
    along = Window.partitionBy("doc").orderBy("first", "count").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(~goes_on, F.col("first"))).over(along)
    return joined.select("doc", "first", "count", begun.alias("unitig"))


def repeated_spans(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs: doc (long, each once, in the documents' order), text. doc, spans: array of (first window, windows, source doc, source's first
    window) that covers exactly the windows of doc that have occurred before: repeats of the graph's unitigs."""
    paths = repeated_paths(docs, seed)
    place = F.min(F.struct("doc", "at")).alias("source")
    equal = paths.groupBy("anchor", "words").agg(F.count(F.lit(1)).alias("n"), place, F.first("node_a").alias("node_a"), F.first("node_b").alias("node_b"))
    equal = stored(equal.select("anchor", "words", "n", "node_a", "node_b", F.col("source.doc").alias("source_doc"), F.col("source.at").alias("source_at")), "substring_equal")
    parted = stored(equal.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "substring_parted")
    whole = paths.join(equal.filter("n > 1").select("anchor", "words", "source_doc", "source_at"), ["anchor", "words"]).filter("doc != source_doc OR at != source_at")
    whole = whole.selectExpr("doc", "at div 16 AS first", "at % 16 + 1 AS count", "source_doc", "source_at div 16 AS source")
    wanted = stored(equal.join(parted, "anchor").select(F.col("source_doc").alias("doc"), F.col("source_at").alias("at")), "substring_wanted")
    windows = repeated_windows(docs, wanted, seed)
    source = F.min(F.struct("doc", "place")).alias("source")
    again = windows.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), source, F.first("node_a").alias("node_a"), F.first("node_b").alias("node_b")).filter("n > 1")
    again = stored(again.select("h", "h2", "node_a", "node_b", F.col("source.doc").alias("source_doc"), F.col("source.place").alias("source")), "substring_again")
    lone = windows.select("h", "h2", "doc", "place").join(again.select("h", "h2", "source_doc", "source"), ["h", "h2"]).filter("doc != source_doc OR place != source")
    lone = lone.selectExpr("doc", "place AS first", "1L AS count", "source_doc", "source")
    compact = equal.filter("n > 1").join(parted, "anchor", "left_anti").selectExpr("node_a", "node_b", "source_doc AS doc", "source_at div 16 AS first", "source_at % 16 + 1 AS count")
    graph = stored(compact.unionByName(again.selectExpr("node_a", "node_b", "source_doc AS doc", "source AS first", "1L AS count")), "substring_graph")
    # paths that are taken apart but also repeat as they are: edges that branch inside, so they are not compacted with others
    branching = equal.filter("n > 1").join(parted, "anchor").selectExpr("source_doc AS doc", "source_at div 16 AS first", "source_at % 16 + 1 AS count", "source_at div 16 AS unitig")
    told = unitigs(graph).unionByName(branching).groupBy(F.col("doc").alias("source_doc"), F.col("first").alias("source"), "count").agg(F.min("unitig").alias("unitig"))
    told = stored(told, "substring_unitigs")
    repeats = stored(whole.unionByName(lone), "substring_repeats")
    emptied(paths, equal, parted, wanted, windows, again, graph)
    # what the graph has compacted into one unitig is one span wherever it is repeated side by side; an edge that the graph lacks has none
    run = repeats.join(told, ["source_doc", "source", "count"]).withColumn("shift", F.col("source") - F.col("first"))
    run = run.groupBy("doc", "source_doc", "shift", "unitig").agg(F.min("first").alias("low"), F.max(F.col("first") + F.col("count")).alias("high"), F.sum("count").alias("sum"), F.collect_list(F.struct("first", "count")).alias("each"))
    each = F.when(F.col("high") - F.col("low") == F.col("sum"), F.array(F.struct(F.col("low").alias("first"), F.col("sum").alias("count")))).otherwise(F.col("each"))
    flat = run.select("doc", "source_doc", "shift", F.explode(each).alias("e")).select("doc", F.struct(F.col("e.first").alias("first"), F.col("e.count").alias("count"), "source_doc", (F.col("e.first") + F.col("shift")).alias("source")).alias("s"))
    # a document's spans are bounded by its own length
    out = stored(flat.groupBy("doc").agg(F.sort_array(F.collect_list("s")).alias("spans")), "substring_spans")
    emptied(told, repeats)
    return out


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, doc_id, text, copies. doc is doc_id where that tells the rows apart; else rows are put in the order of (doc_id, text), null
    first, and numbered in it; rows that repeat are one, copies is how many they are."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 OR doc_id IS NULL").isEmpty():
        return own.select(F.col("doc_id").alias("doc"), "doc_id", "text", F.lit(1).cast("long").alias("copies"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = own.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text", "copies"), "substring_numbered")


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs: doc, doc_id, text, copies; spans as from repeated_spans. A table of doc, doc_id, copies, n_words, n_removed, kept, and told: digests
    of the words of the document's spans, and of those that others have their source in."""
    each = spans.select("doc", F.explode("spans").alias("s")).select("doc", "s.*")
    ends = each.select("source_doc", "source", "count").distinct().groupBy(F.col("source_doc").alias("doc")).agg(F.collect_list(F.struct(F.col("source").alias("first"), "count")).alias("ends"))
    own = docs.select("doc", "doc_id", "text", "copies").join(spans.join(ends, "doc", "full"), "doc", "left")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("count", pa.int64()), ("digest", pa.binary())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 64):
                some, totals, removed, kept, told = batch.slice(s, 64), [], [], [], []
                for text, spans, ends in zip(some.column("text"), some.column("spans"), some.column("ends"), strict=True):
                    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    totals.append(len(words))
                    places = {(p["first"], p["count"]) for p in [*(spans.as_py() or []), *(ends.as_py() or [])]}
                    told.append([{"first": a, "count": n, "digest": xxhash.xxh3_128_digest(b" ".join(words[a : a + n + WINDOW - 1]))} for a, n in places])
                    if spans.is_valid:
                        first, count = (spans.values.field(c).to_numpy() for c in (0, 1))
                        cover = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(cover, first, 1)
                        np.add.at(cover, first + count + WINDOW - 1, -1)
                        stays = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                        removed.append(len(words) - len(stays))
                        words = [words[i] for i in stays.tolist()]
                    else:
                        removed.append(0)
                    kept.append(b" ".join(words))
                columns = [*[some.column(c) for c in ("doc", "doc_id", "copies")], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(told, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "doc_id", "copies", "n_words", "n_removed", "kept", "told"])

    schema = "doc long, doc_id long, copies long, n_words long, n_removed long, kept string, told array<struct<first: long, count: long, digest: binary>>"
    return stored(own.select("doc", "doc_id", "text", "copies", "spans", "ends").mapInArrow(cut, schema), "substring_kept")


def differing(spans: DataFrame, cut: DataFrame) -> int:
    """The number of spans whose words are not their source's, told by the digests that were made where the texts are."""
    told = stored(cut.select("doc", F.explode("told").alias("t")).select("doc", "t.*"), "substring_digests")
    each = spans.select("doc", F.explode("spans").alias("s")).select("doc", "s.*")
    source = told.select(F.col("doc").alias("source_doc"), F.col("first").alias("source"), "count", F.col("digest").alias("expected"))
    wrong = each.join(told, ["doc", "first", "count"]).join(source, ["source_doc", "source", "count"]).filter(F.col("digest") != F.col("expected")).count()
    emptied(told)
    return wrong


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by a space), for each row of docs.

    Words are those between ASCII white space, compared as they are; a null or empty text has none. A word goes if a window of 20
    words that holds it also starts earlier: in a document of smaller id (null is the smallest), of equal id and smaller text, or
    earlier in the document. Rows that repeat are one document and get the same result. An empty table gives an empty table. Other
    columns of docs aren't read."""
    own, seed = numbered(docs, id_col, text_col), 0
    while True:
        spans = repeated_spans(own, seed)
        out = _cut(own, spans)
        if not differing(spans, out):
            break
        emptied(out)
        seed += 1
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.withColumn("copy", copies).select("doc_id", "n_words", "n_removed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM n WHERE r > 1),
w AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d),
k AS (
  SELECT w.doc_id, count(c.p) AS n_removed, coalesce(string_agg(w.w, ' ' ORDER BY w.p) FILTER (WHERE c.p IS NULL), '') AS kept
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.p = c.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
