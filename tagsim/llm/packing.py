"""Best-fit packing: patterns of few documents are fitted to the histogram of lengths by non-negative least squares, rounded and filled;
the rest is packed best-fit from the histogram.

Only the histogram (one count for each length) and the plan made of it meet on the driver; both are bounded by the sequence length, not
by the input. Pieces get a rank among those of their length in Spark, and the plan says for each length and range of ranks which
sequences they go to, and where."""

from __future__ import annotations

import binascii
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsim.llm.common import copy_runs, documents, each_copy, stored
from tagsim.llm.tokens import encode_bytes

MAX_TOKENS = 2048
END_ID = 0
#: Classes of length that the fit tells apart.
CLASSES = 128
#: A repeat of a pattern may leave this part of the sequence empty.
MAX_WASTE = 1024
#: Texts encoded at once; parts into which the pieces of a length are dealt before they are ranked.
BATCH_DOCS = 512
BUCKETS = 1024


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            trial = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (trial > 1e-12).all():
                break
            bad = trial <= 1e-12
            now = x[at]
            step = float((now[bad] / np.maximum(now[bad] - trial[bad], 1e-300)).min())
            x[at] = now + step * (trial - now)
            gone = at[bad & (x[at] <= 1e-12)]
            if not len(gone):
                gone = at[bad]
            x[gone], free[gone] = 0, False
            if not free.any():
                return x
        x[:] = 0
        x[at] = trial
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """Two or three classes of length (class c holds lengths over c - 1 and up to c parts of the sequence) that can fill a sequence: the
    middles of their lengths sum up to it."""
    two = [(i, classes + 1 - i) for i in range((classes + 2) // 2, classes + 1) if classes + 1 - i >= 1]
    three = []
    for total in (classes + 1, classes + 2):
        three += [(i, j, total - i - j) for i in range(1, total) for j in range(1, i + 1) if 1 <= total - i - j <= j]
    return two + three


class Packing:
    """A plan: groups of (count, lengths), each a number of sequences that hold pieces of these lengths in this order."""

    def __init__(self, histogram: dict[int, int], capacity: int = MAX_TOKENS, classes: int = CLASSES):
        self.capacity, self.classes = capacity, min(classes, capacity)
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.done: list[tuple[int, list[int]]] = []
        self.open: dict[int, list[list]] = defaultdict(list)  # by room: [count, lengths]
        full = self.left.pop(capacity, 0)
        if full:
            self.done.append((full, [capacity]))
        self._fit()
        self._best_fit()

    def _add(self, count: int, lengths: list[int]) -> None:
        room = self.capacity - sum(lengths)
        if room:
            self.open[room].append([count, lengths])
        else:
            self.done.append((count, lengths))

    def _take(self, length: int, count: int) -> None:
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _class(self, length: int) -> int:
        return -(-length * self.classes // self.capacity)

    def _fit(self) -> None:
        """Repeat counts of the patterns by least squares, largest first; each repeat takes real lengths that fill the sequence best."""
        if not self.left:
            return
        known = patterns(self.classes)
        a, b = np.zeros((self.classes + 1, len(known))), np.zeros(self.classes + 1)
        for k, p in enumerate(known):
            for c in p:
                a[c, k] += 1
        for n, c in self.left.items():
            b[self._class(n)] += c
        counts = np.floor(nnls(a, b)).astype(np.int64)
        by_class: dict[int, list[int]] = defaultdict(list)
        for n in sorted(self.left):
            by_class[self._class(n)].append(n)
        for k in np.argsort(-counts, kind="stable"):
            todo = int(counts[k])
            while todo > 0:
                chosen = self._choose(known[k], by_class)
                if chosen is None:
                    break
                need = defaultdict(int)
                for n in chosen:
                    need[n] += 1
                count = min([todo, *[self.left[n] // m for n, m in need.items()]])
                for n, m in need.items():
                    self._take(n, m * count)
                self._add(count, chosen)
                todo -= count

    def _choose(self, pattern: tuple[int, ...], by_class: dict[int, list[int]]) -> list[int] | None:
        """Lengths of the pattern's classes whose sum comes nearest the capacity from below; in the last two classes all pairs are tried
        (some hundred at most)."""
        used: dict[int, int] = defaultdict(int)

        def there(c: int) -> list[int]:
            return [n for n in by_class[c] if self.left.get(n, 0) > used[n]]

        chosen = []
        for c in pattern[:-2]:
            options = there(c)
            if not options:
                return None
            chosen.append(max(options, key=lambda n: self.left[n]))
            used[chosen[-1]] += 1
        room, best = self.capacity - sum(chosen), None
        for m in there(pattern[-2]):
            used[m] += 1
            for n in reversed(there(pattern[-1])):
                if m + n <= room:
                    # of equal sums the one that can be repeated most often
                    score = (m + n, min(self.left[m], self.left[n]))
                    if best is None or score > best[0]:
                        best = (score, m, n)
                    break
            used[m] -= 1
        # a poor fit is left to the best-fit stage
        if best is None or room - best[0][0] > self.capacity // MAX_WASTE:
            return None
        return [*chosen, best[1], best[2]]

    def _best_fit(self) -> None:
        """What is left, longest first: into the least room that holds it, else into new sequences, as best-fit-decreasing does."""
        for n in sorted(self.left, reverse=True):
            count = self.left[n]
            while count:
                room = min((r for r in self.open if r >= n and self.open[r]), default=None)
                if room is None:
                    # new sequences, each with as many of this length as fit
                    fit = self.capacity // n
                    if count >= fit:
                        self._add(count // fit, [n] * fit)
                        count %= fit
                    else:
                        self._add(1, [n] * count)
                        count = 0
                    continue
                held = self.open[room].pop()
                fit = room // n
                if count >= held[0] * fit:
                    self._add(held[0], held[1] + [n] * fit)
                    count -= held[0] * fit
                elif count >= fit:
                    some = count // fit
                    self._add(some, held[1] + [n] * fit)
                    self.open[room].append([held[0] - some, held[1]])
                    count -= some * fit
                else:
                    self._add(1, held[1] + [n] * count)
                    if held[0] > 1:
                        self.open[room].append([held[0] - 1, held[1]])
                    count = 0
        self.left = {}

    def groups(self) -> list[tuple[int, list[int]]]:
        return self.done + [(c, lengths) for r in sorted(self.open) for c, lengths in self.open[r]]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys (length << 40 | first rank) in order, and for each (first rank, first sequence, offset)."""
        rank: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for count, lengths in self.groups():
            at = 0
            for n in lengths:
                rows.append((n << 40 | rank[n], rank[n], sequence, at))
                rank[n] += count
                at += n
            sequence += count
        found = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        return found[:, 0], found[:, 1:]


def cut_lengths(total: int, capacity: int = MAX_TOKENS) -> list[int]:
    """Only longer documents are cut; the first piece takes what is over."""
    if total <= capacity:
        return [total]
    over = total % capacity
    return [over] * (over > 0) + [capacity] * (total // capacity)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = MAX_TOKENS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (binary, 32-bit; only with_ids), for each piece of each row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), BATCH_DOCS):
                some = batch.slice(s, BATCH_DOCS)
                rows = []
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode_bytes(some.column("text").to_pylist(), tokenizer_path), strict=True):
                    ids += end
                    at = 0
                    for piece, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        part = ids[4 * at : 4 * (at + n)]
                        rows.append((doc_id, piece, at, n, binascii.crc32(part), part))
                        at += n
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:keep], kinds[:keep], strict=True)], names=names[:keep])

    return own.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int = MAX_TOKENS) -> DataFrame:
    """pieces: doc_id, piece, start, length, ids_crc32, copies (how often the row stands for itself) and others, as a table that reads the
    same each time. One row for each copy, with sequence_id and offset.

    Lengths are from 1 to capacity. A length of which there is any number of pieces is dealt into BUCKETS parts by a hash of the piece
    and its run of copies; pieces are ranked within a part, and parts by their counts."""
    by = ["length", "bucket"]
    own = copy_runs(pieces).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "run"), F.lit(BUCKETS)).cast("int"))
    counts = stored(own.groupBy(*by).agg(F.sum("copies").alias("n")), "pack_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, entries = Packing(histogram, capacity).table()
    base = counts.select(*by, (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy(*by).orderBy("doc_id", "piece", "ids_crc32", "start", "run").rowsBetween(Window.unboundedPreceding, 0)
    ranked = own.withColumn("before", F.sum("copies").over(inside) - F.col("copies")).join(base, by)
    ranked = each_copy(ranked).withColumn("rank", F.col("base") + F.col("before") + F.col("of_run")).drop("base", "before", "of_run", "run", "copies", "bucket")
    kept = [c for c in ranked.columns if c != "rank"]
    types = dict(ranked.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            found = entries[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            sequence = found[:, 1] + rank - found[:, 0]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(found[:, 2])], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = MAX_TOKENS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (only with_ids), for each piece of each row of docs.

    A null text is empty and has its end id alone; a null id stays. Rows that repeat are packed each. An empty table gives an empty
    table. Other columns of docs aren't read."""
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, with_ids, id_col, text_col)
    # rows that repeat are one row with their number, so that they don't all meet in one bucket
    pieces = stored(pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("copies")), "pack_pieces")
    return pack_pieces(pieces, capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """packed: from pack_documents(with_ids=True). sequence_id, doc_ids, lengths, n_tokens, ids (binary), one row for each sequence."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", F.hex("ids").alias("ids")))).alias("p"))
    return parts.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"), F.aggregate("p.length", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"), F.unhex(F.array_join("p.ids", "")).alias("ids"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
