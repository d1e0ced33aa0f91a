"""Pairs of sets, told block against block.

Sets are packed into blocks of bounded size, each a row of a table: the sets' tags with the places of the sets that have them. Every block of one side meets every
block of the other in a task (a Cartesian product of two small tables, so nothing is shuffled for it), and the task gives out what is asked for and nothing else:
each set's k best, the pairs at a threshold, or counts. So what is written grows with the sets and with the result, never with the pairs that share a tag.

Sets of about one size share a block, and in a pair of blocks the other filters are worked out anew: a set of a score of at least t shares
`t * sqrt(|a| |b|)` tags, so all but that many less one of its tags are looked up first, those that the fewest sets of the block have; only what they find is looked at
further."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsim.sources.tables import written

#: Sets and tags (of all its sets) of a block at most, half as many tags where large blocks meet each other; a single larger set is a block. Places are 16-bit numbers.
BLOCK_SETS, BLOCK_TAGS = 32_768, 1 << 21
#: Blocks that few sets are cut into, so that several tasks have work, and sets of such a block at least.
SPREAD, LEAST_SETS = 16, 1024
#: Blocks of a base from which on a first round against those of like size finds bounds for a second.
ROUNDS = 4
#: Rows that a task gives out at once.
BATCH = 65_536
#: Loosens bounds, so that rounding never decides for them.
SLACK = 1e-9
PACKED = "block int, low long, high long, sigs binary, sizes binary, counts binary, tags binary, lengths binary, places binary"
BEST = "a_block int, a_place long, a_sig long, b_sig long, score double"


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) * 4).cast("int")


def _dealt(sizes: DataFrame, most_tags: int) -> tuple[Column, int]:
    """sizes: sig, size. The block of a row of (sig, size), and how many there are. Sizes of one class are cut into as many blocks as they need, by the set;
    classes of few sets share one. A row for each class, of which there are four for each doubling of the size, comes to the driver."""
    by = sizes.groupBy(_size_class(F.col("size")).alias("c")).agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("tags")).orderBy("c").collect()
    most = min(BLOCK_SETS, max(LEAST_SETS, -(-sum(r["sets"] for r in by) // SPREAD)))
    deal: dict[int, tuple[int, int]] = {}
    n, sets, tags = 0, 0, 0
    for r in by:
        parts = max(-(-r["sets"] // most), -(-r["tags"] // most_tags))
        if parts == 1 and 0 < sets <= most - r["sets"] and tags <= most_tags - r["tags"]:
            deal[r["c"]], sets, tags = (n - 1, 1), sets + r["sets"], tags + r["tags"]
        else:
            deal[r["c"]], n = (n, parts), n + parts
            sets, tags = (r["sets"], r["tags"]) if parts == 1 else (0, 0)
    if not deal:
        return F.lit(0), 1
    first, parts = (F.create_map(*[F.lit(x) for c, d in deal.items() for x in (c, d[i])]) for i in (0, 1))
    at = _size_class(F.col("size"))
    return (first[at] + F.pmod(F.xxhash64("key"), parts[at].cast("long"))).cast("int"), n


def _packed(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    sig = rows.column("sig").to_numpy()
    # of copies the one of the least number stays; rows go by number, so that a place tells ties
    keys = np.stack([f.to_numpy() for f in rows.column("key").chunk(0).flatten()])
    order = np.lexsort((sig, *keys))
    same = np.concatenate([[False], (keys[:, order[1:]] == keys[:, order[:-1]]).all(axis=0)])
    kept = order[~same]
    kept = kept[np.argsort(sig[kept], kind="stable")]
    rows, sig = rows.take(pa.array(kept)).combine_chunks(), sig[kept]
    tags = rows.column("tags").chunk(0)
    sizes = np.diff(tags.offsets.to_numpy()).astype(np.int64)
    known, at = np.unique(tags.flatten().to_numpy(), return_inverse=True)
    place = np.repeat(np.arange(len(sig)), sizes)[np.argsort(at, kind="stable")].astype(np.uint16)
    lengths = np.bincount(at, minlength=len(known)).astype(np.int32)
    arrays = {"sigs": sig.astype(np.int64), "sizes": sizes, "counts": rows.column("n").to_numpy().astype(np.int64), "tags": known.astype(np.int64), "lengths": lengths, "places": place}
    columns = {"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "low": pa.array([int(sizes.min())], pa.int64()), "high": pa.array([int(sizes.max())], pa.int64())}
    columns |= {k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}
    return pa.table(columns | {"labels": pa.ListArray.from_arrays(pa.array([0, len(sig)], pa.int32()), rows.column("label").chunk(0))})


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of one key, those with a smaller number than all before them in the task."""
    least: dict[tuple, int] = {}
    for batch in batches:
        keys = [f.to_numpy(zero_copy_only=False).tolist() for f in batch.column("key").flatten()]
        kept = []
        for i, (key, sig) in enumerate(zip(zip(*keys), batch.column("sig").to_pylist())):
            if key not in least or sig < least[key]:
                least[key] = sig
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


@dataclass
class SetBlocks:
    """table: block, low, high (sizes), and of its sets, as arrays: sigs, sizes, counts, and tags, lengths and places (the places of the sets that have a tag, `lengths` of them);
    labels."""

    table: DataFrame
    blocks: int

    @classmethod
    def of(cls, rows: DataFrame, sizes: DataFrame, label: Column | None = None, most_tags: int | None = None) -> SetBlocks:
        """rows: sig, key (a struct of two longs; copies of a set share it), n, tags (numbers, each once, one at least) and what `label` is made of; sizes: key and size of each
        set, one row for each. Of copies in rows, the one with the least sig is the set."""
        block, n = _dealt(sizes, most_tags or BLOCK_TAGS)
        label = F.lit(None).cast("int") if label is None else label
        own = rows.withColumn("size", F.size("tags").cast("long")).select(block.alias("block"), "key", "sig", "n", "tags", label.alias("label"))
        # copies are dropped before they move, so that no block has more than one for each task
        first = own.mapInArrow(_first_copies, own.schema).repartition(n, "block")
        schema = T.StructType.fromDDL(PACKED).add("labels", T.ArrayType(own.schema["label"].dataType))
        return cls(written(first.groupBy("block").applyInArrow(_packed, schema), "set_blocks"), n)


class _Block:
    """A block, in a task. Its arrays are copies, as views would hold the whole batch in memory."""

    def __init__(self, batch: pa.RecordBatch, row: int, end: str):
        def array(name: str, kind) -> np.ndarray:
            return np.frombuffer(batch.column(f"{end}_{name}")[row].as_buffer(), kind).copy()

        self.number = batch.column(f"{end}_block")[row].as_py()
        self.low = batch.column(f"{end}_low")[row].as_py()
        self.sigs, self.sizes, self.counts, self.tags = (array(x, np.int64) for x in ("sigs", "sizes", "counts", "tags"))
        self.lengths = array("lengths", np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        self._places = array("places", np.uint16)
        self.places = self._places.astype(np.int32)
        self.labels = batch.column(f"{end}_labels")[row].values if f"{end}_labels" in batch.schema.names else None
        self.bounds = array("bounds", np.float64) if f"{end}_bounds" in batch.schema.names and batch.column(f"{end}_bounds")[row].is_valid else None
        self.root = np.sqrt(self.sizes)
        self.own_starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self._own: np.ndarray | None = None

    @property
    def own(self) -> np.ndarray:
        """The tags (their places in `tags`) set by set."""
        if self._own is None:
            self._own = np.repeat(np.arange(len(self.tags), dtype=np.int32), self.lengths)[np.argsort(self._places, kind="stable")]
        return self._own

    def having(self, tags: np.ndarray) -> np.ndarray:
        """The places of the sets that have a tag, once for each of the tags."""
        if len(tags) == 1:
            return self.places[self.starts[tags[0]] : self.starts[tags[0] + 1]]
        return np.concatenate([self.places[s:e] for s, e in zip(self.starts[tags].tolist(), self.starts[tags + 1].tolist())])


class _Meeting:
    """Two blocks. at: the place of each tag of a in b, or -1; most: how many of its tags b knows, for each set of a."""

    def __init__(self, a: _Block, b: _Block):
        self.a, self.b = a, b
        at = np.searchsorted(b.tags, a.tags)
        at[at == len(b.tags)] = 0
        self.at = np.where(b.tags[at] == a.tags, at, -1)
        before = np.concatenate([[0], np.cumsum((self.at >= 0)[a.own], dtype=np.int32)])
        self.most = before[a.own_starts[1:]] - before[a.own_starts[:-1]]
        self.mark = np.zeros(len(b.tags), dtype=bool)

    def possible(self, bounds: np.ndarray | float) -> np.ndarray:
        """The sets of a that can reach their bound here."""
        most = np.maximum(self.most, 1)
        return np.flatnonzero((self.most > 0) & (most >= bounds * self.a.root * np.sqrt(np.maximum(most, self.b.low)) - SLACK))

    def shared(self, i: int, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Places, ascending, of the sets of b that share tags with set i of a and may have a score of t, and how many they share."""
        a, b = self.a, self.b
        tags = self.at[a.own[a.own_starts[i] : a.own_starts[i + 1]]]
        tags = tags[tags >= 0]
        root = a.root[i]
        least = max(1, math.ceil(t * root * math.sqrt(b.low) - SLACK), math.ceil(t * t * a.sizes[i] - SLACK))
        if len(tags) < least:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if least > 1:
            lengths = b.lengths[tags]
            order = np.argsort(lengths)
            head, tail = tags[order[: len(tags) - least + 1]], tags[order[len(tags) - least + 1 :]]
            looked, rest = int(b.lengths[head].sum()), int(b.lengths[tail].sum())
            if looked * 4 < rest:
                return self._from(head, tail, looked, rest, least, t * root)
        dots = np.bincount(b.having(tags), minlength=len(b.sigs))
        found = np.flatnonzero(dots >= np.maximum(b.root * (t * root) - SLACK, 1) if t > 0 else dots)
        return found, dots[found]

    def _from(self, head: np.ndarray, tail: np.ndarray, looked: int, rest: int, least: int, t: float) -> tuple[np.ndarray, np.ndarray]:
        b = self.b
        if looked * 8 < len(b.sigs):
            found, dots = np.unique(b.having(head), return_counts=True)
        else:
            dots = np.bincount(b.having(head), minlength=len(b.sigs))
            found = np.flatnonzero(dots)
            dots = dots[found]
        kept = dots + least - 1 >= b.root[found] * t - SLACK
        found, dots = found[kept], dots[kept]
        if len(found):
            sizes = b.sizes[found]
            if (work := int(sizes.sum())) < rest:
                self.mark[tail] = True
                before = np.cumsum(sizes) - sizes
                hits = self.mark[b.own[np.repeat(b.own_starts[found] - before, sizes) + np.arange(work)]]
                dots = dots + np.add.reduceat(hits, before, dtype=np.int64)
                self.mark[tail] = False
            else:
                dots = dots + np.bincount(b.having(tail), minlength=len(b.sigs))[found]
            kept = dots >= b.root[found] * t - SLACK
            found, dots = found[kept], dots[kept]
        return found, dots


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[_Meeting]:
    a = None
    while (batch := next(batches, None)) is not None:
        for row in range(batch.num_rows):
            if a is None or a.number != batch.column("a_block")[row].as_py():
                a = _Block(batch, row, "a")
            yield _Meeting(a, _Block(batch, row, "b"))
        # gone before the next one comes
        del batch


def _pairs(a: DataFrame, b: DataFrame, condition: Column | None = None, labels: bool = False) -> DataFrame:
    """Each block of a beside each of b for which the condition holds."""
    a, b = (t.select(*[F.col(c).alias(f"{end}_{c}") for c in t.columns if labels or c != "labels"]) for t, end in ((a, "a"), (b, "b")))
    return a.join(b.hint("shuffle_replicate_nl"), F.lit(True) if condition is None else condition)


def _rows(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)


def _best(k: int):
    """For each set of a, the k best sets of b that the task sees and that reach the set's bound: by score, then by number."""
    def flushed(a: _Block, score: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        place, column = np.nonzero(score > 0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), a.number, dtype=np.int32)), pa.array(place), pa.array(a.sigs[place]), pa.array(sig[place, column]), pa.array(score[place, column])], names=["a_block", "a_place", "a_sig", "b_sig", "score"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        for m in _met(batches):
            if a is not m.a:
                if a is not None:
                    yield flushed(a, top, sig)
                a, top, sig = m.a, np.zeros((len(m.a.sigs), k)), np.zeros((len(m.a.sigs), k), dtype=np.int64)
                bounds = np.zeros(len(a.sigs)) if a.bounds is None else a.bounds.copy()
            for i in m.possible(bounds).tolist():
                place, dots = m.shared(i, bounds[i])
                score = dots / (a.root[i] * m.b.root[place])
                kept = score >= bounds[i]
                place, score = place[kept], score[kept]
                if len(score) > k:
                    kept = score >= np.partition(score, len(score) - k)[len(score) - k]
                    place, score = place[kept], score[kept]
                if not len(score):
                    continue
                # places ascend as numbers do
                order = np.argsort(-score, kind="stable")[:k]
                score, own = np.concatenate([top[i], score[order]]), np.concatenate([sig[i], m.b.sigs[place[order]]])
                order = np.lexsort((own, -score))[:k]
                top[i], sig[i] = score[order], own[order]
                bounds[i] = max(bounds[i], top[i, k - 1])
        if a is not None:
            yield flushed(a, top, sig)

    return best


def best_pairs(a: SetBlocks, b: SetBlocks, k: int) -> DataFrame:
    """a_sig, b_sig, score: for each set of a the k best sets of b that share a tag, by score, then by number. Where b has several blocks, a set first meets
    those of about its own size; the k-th best score found there is a bound, below which the others give nothing out."""
    best = Window.partitionBy("a_sig").orderBy(F.desc("score"), "b_sig")

    def cut(found: DataFrame) -> DataFrame:
        return found.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k)

    if b.blocks < ROUNDS:
        return cut(_pairs(a.table, b.table).mapInArrow(_best(k), BEST)).select("a_sig", "b_sig", "score")
    alike = (F.col("b_low") <= F.col("a_high")) & (F.col("b_high") >= F.col("a_low"))
    first = written(cut(_pairs(a.table, b.table, alike).mapInArrow(_best(k), BEST)), "best_alike")

    def bound(rows: pa.Table) -> pa.Table:
        out = np.zeros(rows.column("sets")[0].as_py())
        out[rows.column("a_place").to_numpy()] = rows.column("score").to_numpy()
        return pa.table({"a_block": pa.array([rows.column("a_block")[0].as_py()], pa.int32()), "bounds": pa.array([out.tobytes()], pa.binary())})

    sets = a.table.select(F.col("block").alias("a_block"), (F.length("sigs") / 8).cast("long").alias("sets"))
    bounds = first.filter(F.col("__n") == k).join(F.broadcast(sets), "a_block").groupBy("a_block").applyInArrow(bound, "a_block int, bounds binary")
    bounded = a.table.join(bounds.withColumnRenamed("a_block", "block"), "block", "left")
    bounded = written(bounded, "bounded_blocks")
    far = _pairs(bounded, b.table, ~alike).mapInArrow(_best(k), BEST)
    return cut(first.drop("__n").unionByName(far)).select("a_sig", "b_sig", "score")


def near_pairs(sets: SetBlocks, threshold: float, labels: bool = False) -> DataFrame:
    """a_sig, b_sig, score, a_n, b_n and, if asked for, a_label, b_label: pairs of sets, each once, a set with itself too, of a score of `threshold` or more, which is over 0."""
    kind = sets.table.schema["labels"].dataType.elementType.simpleString()
    names = ["a_sig", "b_sig", "score", "a_n", "b_n"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _met(batches):
            own, other, score, rows = [], [], [], 0

            def given() -> pa.RecordBatch:
                x, y = np.repeat(np.array([i for i, _ in own]), [n for _, n in own]), np.concatenate(other)
                columns = [pa.array(c) for c in (m.a.sigs[x], m.b.sigs[y], np.concatenate(score), m.a.counts[x], m.b.counts[y])]
                if labels:
                    columns += [m.a.labels.take(pa.array(x)), m.b.labels.take(pa.array(y))]
                return pa.RecordBatch.from_arrays(columns, names=[*names, "a_label", "b_label"] if labels else names)

            for i in m.possible(threshold).tolist():
                place, dots = m.shared(i, threshold)
                if m.a.number == m.b.number:
                    place, dots = place[place >= i], dots[place >= i]
                exact = dots / (m.a.root[i] * m.b.root[place])
                kept = exact >= threshold
                if n := int(kept.sum()):
                    own.append((i, n))
                    other.append(place[kept])
                    score.append(exact[kept])
                    rows += n
                if rows >= BATCH:
                    yield given()
                    own, other, score, rows = [], [], [], 0
            if rows:
                yield given()

    # a larger set is at most 1 / threshold^2 times as large
    reach = F.lit(threshold * threshold)
    fits = (F.col("a_block") <= F.col("b_block")) & (F.col("a_high") >= F.col("b_low") * reach - SLACK) & (F.col("b_high") >= F.col("a_low") * reach - SLACK)
    schema = "a_sig long, b_sig long, score double, a_n long, b_n long" + (f", a_label {kind}, b_label {kind}" if labels else "")
    return _pairs(sets.table, sets.table, fits, labels).mapInArrow(near, schema)


def all_pairs(a: SetBlocks, b: SetBlocks) -> DataFrame:
    """a_sig, b_sig, score of all pairs that share a tag."""
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _met(batches):
            for i in m.possible(0.0).tolist():
                place, dots = m.shared(i, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), m.a.sigs[i])), pa.array(m.b.sigs[place]), pa.array(dots / (m.a.root[i] * m.b.root[place]))], names=["a_sig", "b_sig", "score"])

    return _pairs(a.table, b.table).mapInArrow(every, "a_sig long, b_sig long, score double")


def pair_counts(a: SetBlocks, b: SetBlocks) -> DataFrame:
    """a_size, b_size, shared, n: how many pairs of rows, of sets that share a tag, there are of these numbers of tags. Counted where the blocks meet, a row for each
    of the numbers that occur."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _met(batches):
            sizes, kind = np.unique(m.b.sizes, return_inverse=True)
            weight = m.b.counts.astype(np.float64)  # whole numbers, exact up to 2 ** 53
            totals: dict[int, np.ndarray] = {}
            for i in m.possible(0.0).tolist():
                dots = np.bincount(m.b.having((tags := m.at[m.a.own[m.a.own_starts[i] : m.a.own_starts[i + 1]]])[tags >= 0]), minlength=len(m.b.sigs))
                size = int(m.a.sizes[i])
                own = totals.setdefault(size, np.zeros((size + 1) * len(sizes), dtype=np.int64))
                own += int(m.a.counts[i]) * np.bincount(dots * len(sizes) + kind, weight, minlength=len(own)).astype(np.int64)
            for size, own in totals.items():
                own[: len(sizes)] = 0  # those that share none
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(at), size), sizes[at % len(sizes)], at // len(sizes), own[at])], names=["a_size", "b_size", "shared", "n"])

    found = _pairs(a.table, b.table).mapInArrow(counted, "a_size long, b_size long, shared long, n long")
    return found.groupBy("a_size", "b_size", "shared").agg(F.sum("n").alias("n"))
