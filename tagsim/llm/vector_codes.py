"""Vector code compression: product codes by Lloyd's rounds in integers, with a cover tree over each part of the vectors of a block.

Each component x becomes the integer floor(scale * x), and a vector is cut into equal parts. A task packs its rows into blocks of bounded
size; a block holds, for each part, a tree of nested nodes with halving radii over its different sub-vectors, and cumulative sums along
the tree's order. Trees are built once and stored; a round only walks them. An entry of the codebook is ruled out for a node if it is
farther from the node's centre than the nearest entry by more than twice the node's radius: no vector below can then be nearer to it. A
node with one entry left is assigned whole, and its count and sum come from the cumulative ones; other nodes hand the entries left to
their children, and single sub-vectors are compared exactly. So equal sub-vectors, of however many rows, are one comparison.

Only sums and counts of codebook entries are shuffled, and only the codebooks, whose size is fixed, come to the driver. All is worked
out in whole numbers, ties go to the lower index, so results do not depend on how the rows are dealt out. Bounds are loosened, so
that rounding never decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.llm.common import emptied, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block at most; a block has at most BLOCK_VALUES numbers.
BLOCK, BLOCK_VALUES = 2048, 1 << 17
#: Levels of a tree below its root; nodes of the last level are cut into single sub-vectors.
LEVELS = 6
#: Nodes whose distances to all entries are held at once.
CHUNK = 1024
SLACK = 1e-6
#: Numbers of which all squares and products of a part sum up to less than 2^53 are worked out as doubles, which is exact; others as Python's.
EXACT = 1 << 53
#: Base in which sums are handed to Spark: a sum is hi * LIMB + lo.
LIMB = 1 << 60
#: Labels that go to every executor with their sums; more are joined as a table.
MAX_LABELS = 100_000


def _is_small(largest: int, width: int) -> bool:
    return 4 * width * largest * largest < EXACT


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, whole numbers both: exact."""
    largest = max([abs(int(v)) for m in (a, b) if m.size for v in (m.max(), m.min())], default=0)
    if _is_small(largest, a.shape[1]):
        x, y = a.astype(np.float64), b.astype(np.float64)
        return np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ y.T) + np.einsum("ij,ij->i", y, y)[None, :]
    x, y = a.astype(object), b.astype(object)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in y], axis=1) if len(y) else np.zeros((len(x), 0), dtype=object)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class PartTree:
    """Nested nodes over whole-number points, given once each with the rows of it. rows: the block's rows in tree order; points: the different
    points in tree order, point p holds the rows at[p] to at[p + 1]. Node k holds the points start[k] to end[k], its centre is the point start[k];
    its children are the nodes first[k] to last[k], none if it is single."""

    NAMES = ("rows", "at", "start", "end", "radius", "first", "last")

    def __init__(self, points: np.ndarray, **arrays):
        self.points = points
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def of(cls, values: np.ndarray) -> PartTree:
        points, owner = _different(values)
        order: list[int] = []
        nodes: list[list] = []  # start, end, radius, first, last

        def groups_of(members: np.ndarray, radius: float) -> list[np.ndarray]:
            """Greedy net: each group has its centre first and lies within `radius` of it."""
            own, free, out = points[members], np.ones(len(members), dtype=bool), []
            for low in range(0, len(members), CHUNK):
                left = np.flatnonzero(free[low : low + CHUNK]) + low
                if not len(left):
                    continue
                near = _roots(squared(own[left], own[low:])) <= radius
                for i, close in zip(left.tolist(), near, strict=True):
                    if free[i]:
                        close = close & free[low:]
                        close[i - low] = False
                        free[low:] &= ~close
                        free[i] = False
                        out.append(np.concatenate([members[i : i + 1], members[low:][close]]))
            return out

        def add(groups: list[np.ndarray]) -> int:
            first = len(nodes)
            for g in groups:
                away = float(_roots(squared(points[g[:1]], points[g])).max()) if len(g) > 1 else 0.0
                nodes.append([0, 0, away, 0, 0])
            return first

        def place(k: int, members: np.ndarray, level: int) -> None:
            node = nodes[k]
            node[0] = len(order)
            if len(members) == 1:
                order.append(int(members[0]))
            else:
                single = level == LEVELS
                groups = [members[i : i + 1] for i in range(len(members))] if single else groups_of(members, node[2] / 2)
                node[3] = add(groups)
                node[4] = len(nodes)
                for j, g in enumerate(groups):
                    place(node[3] + j, g, level + 1)
            node[1] = len(order)

        if len(points):
            place(add([np.arange(len(points))]), np.arange(len(points)), 0)
        placed = np.array(order, dtype=np.int64)
        rank = np.empty(len(points), dtype=np.int64)
        rank[placed] = np.arange(len(points))
        rows = np.argsort(rank[owner], kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(rank[owner], minlength=len(points)))]).astype(np.int64)
        table = np.array(nodes, dtype=np.float64).reshape(-1, 5)
        start, end, first, last = (table[:, c].astype(np.int64) for c in (0, 1, 3, 4))
        return cls(points[placed], rows=rows.astype(np.int64), at=at, start=start, end=end, radius=table[:, 2].copy(), first=first, last=last)

    def assign(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry of each point, entries of whole ranges as rows start, end, entry, exact comparisons of single points)."""
        entry = np.zeros(len(self.points), dtype=np.int64)
        ranges: list[np.ndarray] = []
        compared = 0
        nodes = np.arange(min(1, len(self.start)))
        allowed = np.ones((len(nodes), len(codebook)), dtype=bool)
        while len(nodes):
            below, masks = [], []
            for low in range(0, len(nodes), CHUNK):
                own, may = nodes[low : low + CHUNK], allowed[low : low + CHUNK]
                d = squared(self.points[self.start[own]], codebook)
                if d.dtype == object:
                    # entries that are ruled out already are farther than all others
                    far = max(int(d.max()), 0) + 1
                    held = np.where(may, d, far)
                else:
                    held = np.where(may, d, np.inf)
                best = held.argmin(axis=1)  # the first of equals
                away = _roots(held[np.arange(len(own)), best])
                reach = (away + 2 * self.radius[own]) * (1 + SLACK) + SLACK
                may = may & (_roots(d) <= reach[:, None])
                single = self.end[own] - self.start[own] == 1
                done = single | (may.sum(axis=1) == 1)
                compared += int((single & (may.sum(axis=1) > 1)).sum())
                ranges.append(np.stack([self.start[own[done]], self.end[own[done]], best[done]], axis=1))
                below.append(own[~done])
                masks.append(may[~done])
            left, mask = np.concatenate(below), np.concatenate(masks)
            n = self.last[left] - self.first[left]
            nodes = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[left], n)
            allowed = np.repeat(mask, n, axis=0)
        whole = np.concatenate(ranges) if ranges else np.zeros((0, 3), dtype=np.int64)
        whole = whole[np.argsort(whole[:, 0], kind="stable")]
        entry = np.repeat(whole[:, 2], whole[:, 1] - whole[:, 0])
        return entry, whole, compared

    def totals(self, whole: np.ndarray, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and componentwise sums of each entry, from cumulative ones at the ends of the ranges."""
        weight = np.diff(self.at)
        largest = max((abs(int(v)) for v in (self.points.max(), self.points.min())), default=0) if self.points.size else 0
        small = largest * max(1, int(self.at[-1])) < 1 << 62
        points = self.points.astype(np.int64 if small else object)
        weighted = points * weight[:, None].astype(points.dtype)
        sums = np.concatenate([np.zeros((1, points.shape[1]), dtype=points.dtype), np.cumsum(weighted, axis=0)])
        count, total = np.zeros(n_entries, dtype=np.int64), np.zeros((n_entries, points.shape[1]), dtype=points.dtype)
        np.add.at(count, whole[:, 2], self.at[whole[:, 1]] - self.at[whole[:, 0]])
        np.add.at(total, whole[:, 2], sums[whole[:, 1]] - sums[whole[:, 0]])
        return count, total


def _different(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, in order of their first occurrence, and the number of each row's."""
    seen: dict = {}
    keys = map(bytes, np.ascontiguousarray(values)) if values.dtype != object else map(tuple, values)
    owner = np.fromiter((seen.setdefault(k, len(seen)) for k in keys), dtype=np.int64, count=len(values))
    first = np.full(len(seen), len(values), dtype=np.int64)
    np.minimum.at(first, owner, np.arange(len(values)))
    return values[first], owner


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, as long integers, or as Python's where a component is too large for them. A product with a
    power of two is exact, but for one that is too large for a double."""
    scaled = vectors.astype(np.float64) * scale
    if not np.isfinite(scaled).all():
        return np.array([[int(x) * scale if abs(x) > 2**53 else int(np.floor(x * scale)) for x in row] for row in vectors.astype(np.float64).tolist()], dtype=object).reshape(vectors.shape)
    floors = np.floor(scaled)
    if not floors.size or np.abs(floors).max() < 2**53:
        return floors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in floors.tolist()], dtype=object).reshape(vectors.shape)


def _pack(numbers: np.ndarray, trees: list[PartTree]) -> bytes:
    """A block in the shared folder: numbers and trees, with their types."""
    import io
    import json

    arrays = [numbers, *[a for t in trees for a in (t.points, *[getattr(t, n) for n in PartTree.NAMES])]]
    out, head = io.BytesIO(), []
    for a in arrays:
        data = json.dumps([[str(v) for v in r] for r in a.tolist()]).encode() if a.dtype == object else np.ascontiguousarray(_narrow(a)).tobytes()
        head.append([a.dtype.str if a.dtype == object else _narrow(a).dtype.str, list(a.shape), len(data)])
        out.write(data)
    top = json.dumps(head).encode()
    return len(top).to_bytes(4, "little") + top + out.getvalue()


def _narrow(a: np.ndarray) -> np.ndarray:
    """Longs that fit go as 32 bits."""
    return a.astype(np.int32) if a.dtype == np.int64 and (not a.size or np.abs(a).max() < 1 << 31) else a


def _unpack(data: memoryview) -> tuple[np.ndarray, list[PartTree]]:
    import json

    top = int.from_bytes(data[:4], "little")
    at, arrays = 4 + top, []
    for kind, shape, size in json.loads(bytes(data[4:at])):
        if kind == "|O":
            a = np.array([[int(v) for v in r] for r in json.loads(bytes(data[at : at + size]))], dtype=object).reshape(shape)
        else:
            a = np.frombuffer(data[at : at + size], dtype=kind).reshape(shape)
            a = a.astype(np.int64) if a.dtype == np.int32 else a
        arrays.append(a)
        at += size
    each = 1 + len(PartTree.NAMES)
    trees = [PartTree(arrays[i], **dict(zip(PartTree.NAMES, arrays[i + 1 : i + each], strict=True))) for i in range(1, len(arrays), each)]
    return arrays[0], trees


def _blocks(own: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """own: vec_id, label, vec, all of `dim` components. Rows ids, labels, data, one for each block of a task's rows."""
    size = max(1, min(BLOCK, BLOCK_VALUES // dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            vec = table.column("vec").combine_chunks()
            numbers = whole_numbers(vec.flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim), scale)
            trees = [PartTree.of(p) for p in np.split(numbers, parts, axis=1)]
            columns = [pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*columns, pa.array([_pack(numbers, trees)], pa.binary())], names=["ids", "labels", "data"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    return own.select("vec_id", "label", "vec").mapInArrow(pack, "ids array<long>, labels array<long>, data binary")


def _one_by_one(batch: pa.RecordBatch) -> Iterator[tuple[list, list, np.ndarray, list[PartTree]]]:
    for i in range(batch.num_rows):
        yield (batch.column("ids")[i].as_py(), batch.column("labels")[i].as_py(), *_unpack(memoryview(batch.column("data")[i].as_buffer())))


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round. A task adds up its blocks' sums; what comes to the driver is one row for each number of the codebooks."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), dtype=object) for b in books]
        total = [np.zeros(b.shape, dtype=object) for b in books]
        for batch in batches:
            for _, _, _, trees in _one_by_one(batch):
                for p, tree in enumerate(trees):
                    c, t = tree.totals(tree.assign(books[p])[1], len(books[p]))
                    count[p] += c
                    total[p] += t
        rows = [(p, e, k, int(s) // LIMB, int(s) % LIMB, int(count[p][e])) for p in range(len(books)) for e in np.flatnonzero(count[p]).tolist() for k, s in enumerate(total[p][e])]
        if rows:
            part, entry, place, hi, lo, n = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64(), pa.int64()]
            from decimal import Decimal

            hi = [Decimal(h) for h in hi]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((part, entry, place, hi, lo, n), kinds, strict=True)], names=["part", "entry", "place", "hi", "lo", "n"])

    found = blocks.mapInArrow(totals, "part int, entry int, place int, hi decimal(38,0), lo long, n long")
    found = found.groupBy("part", "entry", "place").agg(F.sum("hi").alias("hi"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("lo"), F.sum("n").alias("n"))
    after = [b.astype(object) for b in books]
    for r in found.collect():
        after[r["part"]][r["entry"], r["place"]] = (int(r["hi"]) * LIMB + int(r["lo"])) // r["n"]
    return [_plain(b) for b in after]


def _plain(book: np.ndarray) -> np.ndarray:
    """As longs, where they fit."""
    return book.astype(np.int64) if not book.size or max(abs(int(book.max())), abs(int(book.min()))) < 2**62 else book


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def vector_codes(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of embeddings whose vector can be coded.

    Vectors that are null or empty, or hold null or non-finite components, have no row; nor have those of another length than the first
    kept vector by vec_id, whose length must be a multiple of `parts`. The codebooks start as the parts of the first `entries` kept rows by
    (vec_id, vector), null ids last, repeats included, and are fewer in a smaller table. A null label is a label of its own. Rows that repeat
    are vectors each. error is held at the greatest long where it would be more. An empty table gives an empty table. Other columns
    aren't read. Components up to 1e38 are worked out exactly."""
    own = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fit = F.coalesce((F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    own = own.filter(fit)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vec")]
    first = own.orderBy(*order).limit(1).collect()
    columns = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not first:
        return embeddings.sparkSession.createDataFrame([], columns)
    dim = len(first[0]["vec"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    own = own.filter(F.size("vec") == dim)
    start = whole_numbers(np.array([r["vec"] for r in own.orderBy(*order).limit(entries).select("vec").collect()], dtype=np.float64).reshape(-1, dim), scale)
    books = [_plain(b) for b in np.split(start, parts, axis=1)]
    blocks = stored(_blocks(own, dim, parts, scale), "code_blocks")
    for _ in range(rounds):
        books = _round(blocks, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, numbers, trees in _one_by_one(batch):
                codes, error = np.zeros((len(ids), parts), dtype=np.uint8 if entries <= 256 else np.uint32), [0] * len(ids)
                for p, tree in enumerate(trees):
                    entry = tree.assign(books[p])[0]
                    away = [int(d) for d in ((tree.points.astype(object) - books[p][entry].astype(object)) ** 2).sum(axis=1)] if tree.points.dtype == object or books[p].dtype == object else _own_squares(tree.points, books[p][entry])
                    of = np.repeat(np.arange(len(tree.points)), np.diff(tree.at))
                    codes[tree.rows, p] = entry[of]
                    for row, point in zip(tree.rows.tolist(), of.tolist(), strict=True):
                        error[row] += away[point]
                width = 2 if entries <= 256 else 8
                text = ["".join(f"{c:0{width}x}" for c in row) for row in codes.tolist()]
                held = [min(e, (1 << 63) - 1) for e in error]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(text), pa.array(held, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = stored(blocks.mapInArrow(code, "vec_id long, label long, code string, error long"), "codes")
    emptied(blocks)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by = F.coalesce(F.col("label").cast("string"), F.lit(""))
    sums = stored(coded.groupBy(by.alias("by")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")), "label_errors")
    sums = F.broadcast(sums) if sums.count() <= MAX_LABELS else sums
    digest = F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    return coded.withColumn("by", by).join(sums, "by").select("vec_id", "code", "error", "label_error", digest)


def _own_squares(points: np.ndarray, entries: np.ndarray) -> list[int]:
    """Squared distance of each row to the entry beside it."""
    apart = points - entries
    if apart.size and apart.shape[1] * int(np.abs(apart).max()) ** 2 >= 1 << 63:
        return [sum(v * v for v in row) for row in apart.tolist()]
    return (apart * apart).sum(axis=1).tolist()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """Every part against every entry, in each round."""
    near = "SELECT p.vec_id, p.part, arg_min(b.entry, struct_pack(d := {d}, e := b.entry)) AS entry, min({d}) AS d FROM points p JOIN b{r} b ON p.part = b.part GROUP BY p.vec_id, p.part"
    d = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    ctes = [
        "kept AS MATERIALIZED (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0)",
        f"points AS MATERIALIZED (SELECT vec_id, part, list_transform(e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}], lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM kept, (SELECT unnest(range({parts})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, rank - 1 AS entry, v FROM points JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM kept) USING (vec_id) WHERE rank <= {entries})",
    ]
    for r in range(rounds):
        ctes.append(f"a{r} AS MATERIALIZED ({near.format(d=d, r=r)})")
        ctes.append(
            f"m{r} AS (SELECT part, entry, list(x ORDER BY place) AS v FROM (SELECT a.part, a.entry, place, floor(sum(p.v[place])::DOUBLE / count(*))::BIGINT AS x FROM a{r} a JOIN points p USING (vec_id, part), (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM points))) AS place) GROUP BY a.part, a.entry, place) GROUP BY part, entry)"
        )
        ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)")
    ctes.append(f"a{rounds} AS MATERIALIZED ({near.format(d=d, r=rounds)})")
    ctes.append(f"coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"


OP11_SQL = _oracle()
