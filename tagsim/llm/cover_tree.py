"""Embedding near-dedup: cover trees with halving radii over blocks of unit vectors, and dual traversal of pairs of blocks.

A node stands for vectors within its covering radius of its centre. A pair of nodes is dropped if no vector of the one can reach the
threshold with one of the other, and counted whole if all must; pairs between are split into their children's, down to single
vectors, whose cosine is worked out in double precision. Node bounds are loosened by SLACK, so rounding never decides for the bounds.

The root covers the sphere. Its children are cells around pivots, taken from a bounded sample: they say only which block a vector
falls into, never the result. Cells are cut into blocks of bounded size, so a group of near copies of any size is spread over many
blocks. A block's tree is built once, with the links inside the block, and stored; then every pair of blocks that the cells' bounds
allow is traversed, in tiles of a few blocks by a few. Pairs and tiles are made by joins of the block table; a tile is one task.

What comes out grows with the vectors and the pairs of blocks, not with the links: partners are counted, and links are told by the
groups of each block that they join. In data without clusters, where all vectors are about equally far from each other, no bound can
drop a pair of blocks, and the work grows as the square, at the speed of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsim.llm.common import emptied, stored
from tagsim.llm.components import components

MIN_COSINE = 0.9
#: Vectors of a block: at most, and in small inputs, so that there are blocks for many tasks. A block has at most BLOCK_VALUES numbers.
BLOCK = 4096
SMALL_BLOCK = 1024
BLOCK_VALUES = 1 << 19
#: Blocks on each side of a tile; tasks at most.
TILE_BLOCKS = 3
MAX_TASKS = 100_000
#: Pivots at most: the sample from which cells are made, whatever the input's size.
MAX_PIVOTS = 256
#: Radii of the levels inside a block. The widest nodes are compared in matrix products anyway; wider ones would hold a few unrelated
#: vectors each, which no bound could tell from the rest.
RADII = (0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625)
SLACK = 1e-4
#: Rows of a matrix product, and pairs of nodes, that are held at once.
TILE = 256
PAIRS = 1 << 15


class Tree:
    """Nested nodes over unit vectors, which are put in tree order (`order`): node k holds rows start[k] to end[k], its centre is row
    centre[k], its children are the nodes first[k] to last[k] (none for a leaf). Nodes 0 to n_top are the widest, by ascending radius."""

    def __init__(self, order, n_top, start, end, centre, radius, first, last):
        self.order, self.n_top = order, n_top
        self.start, self.end, self.centre, self.radius, self.first, self.last = start, end, centre, radius, first, last

    @classmethod
    def of(cls, x: np.ndarray) -> Tree:
        short, order, nodes = x.astype(np.float32), [], []  # nodes: start, end, centre, radius, first, last

        def net(rows: np.ndarray, level: int) -> list[np.ndarray]:
            """Greedy net of the level's radius over rows: groups, each with its centre first. Only TILE rows of products are held."""
            bound, free, out = np.float32(1 - RADII[level] ** 2 / 2), np.ones(len(rows), dtype=bool), []
            own = short[rows]
            for low in range(0, len(rows), TILE):
                left = np.flatnonzero(free[low : low + TILE]) + low
                # rows before this tile are centres, or in a group, already
                close = own[left] @ own[low:].T >= bound
                lone = close.sum(axis=1) <= 1
                for i, near, single in zip(left.tolist(), close, lone.tolist(), strict=True):
                    if free[i]:
                        if single:
                            free[i] = False
                            out.append(rows[i : i + 1])
                            continue
                        near = near & free[low:]
                        near[i - low] = False
                        free[low:] &= ~near
                        free[i] = False
                        out.append(np.concatenate([rows[i : i + 1], rows[low:][near]]))
            return out

        def radius_of(rows: np.ndarray) -> float:
            return float(np.linalg.norm(x[rows] - x[rows[0]], axis=1).max()) if len(rows) > 1 else 0.0

        def add(groups: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
            made = sorted(((radius_of(g), g) for g in groups), key=lambda m: m[0])
            nodes.extend([0, 0, int(g[0]), r, 0, 0] for r, g in made)
            return made

        def place(k: int, rows: np.ndarray, level: int) -> None:
            node = nodes[k]
            node[0] = len(order)
            if len(rows) == 1 or level + 1 == len(RADII):
                order.extend(rows.tolist())
            else:
                node[4] = len(nodes)
                groups = add(net(rows, level + 1))
                node[5] = node[4] + len(groups)
                for j, (_, g) in enumerate(groups):
                    place(node[4] + j, g, level + 1)
            node[1] = len(order)

        top = add(net(np.arange(len(x)), 0))
        # depth first, so that a node's rows stay together
        for k, (_, rows) in enumerate(top):
            place(k, rows, 0)
        placed = np.array(order, dtype=np.int64)
        at = np.empty(len(x), dtype=np.int64)
        at[placed] = np.arange(len(x))
        table = np.array(nodes, dtype=np.float64).reshape(-1, 6)
        start, end, first, last = (table[:, c].astype(np.int64) for c in (0, 1, 4, 5))
        return cls(placed, len(top), start, end, at[table[:, 2].astype(np.int64)], table[:, 3].copy(), first, last)


class Block:
    """A block's vectors in tree order, with their tree: raw (as given), x (unit length), weight, and the top nodes' centres."""

    def __init__(self, raw: np.ndarray, weight: np.ndarray, tree: Tree | None = None):
        x = _unit(raw)
        if tree is None:
            tree = Tree.of(x)
            x, raw, weight = x[tree.order], raw[tree.order], weight[tree.order]
        self.raw, self.x, self.weight, self.tree = raw, x, weight, tree
        self.norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        self.sum = np.concatenate([[0], np.cumsum(weight)])
        self.top = x[tree.centre[: tree.n_top]].astype(np.float32)

    def packed(self) -> bytes:
        t = self.tree
        head = np.array([*self.raw.shape, t.n_top, len(t.start)], dtype="<i8")
        return b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in (self.raw, self.weight, t.start, t.end, t.centre, t.radius, t.first, t.last)]])

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        n, dim, n_top, n_nodes = np.frombuffer(data, "<i8", 4).tolist()
        at, parts = 32, []
        for kind, size in (("<f8", n * dim), ("<i8", n), ("<i8", n_nodes), ("<i8", n_nodes), ("<i8", n_nodes), ("<f8", n_nodes), ("<i8", n_nodes), ("<i8", n_nodes)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += 8 * size
        raw, weight, start, end, centre, radius, first, last = parts
        return cls(raw.reshape(n, dim), weight, Tree(None, n_top, start, end, centre, radius, first, last))


class Groups:
    """Groups of numbered things that links join; each is named by one of its own."""

    def __init__(self, n: int):
        self.name = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Least names spread along the links until nothing changes; names are flattened as they do."""
        a, b = self.name[a], self.name[b]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(self.name, np.maximum(a, b), np.minimum(a, b))
            while (deeper := self.name[self.name] != self.name).any():
                self.name[deeper] = self.name[self.name[deeper]]
            a, b = self.name[a], self.name[b]


def _top_pairs(one: Block, two: Block, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the trees' widest nodes that may hold a link, from matrix products of TILE rows. Nodes ascend by radius, so the last one
    of a tile bounds the tile's."""
    tx, found = one.tree, []
    wide = (two.tree.radius[: two.tree.n_top] + (reach + SLACK)).astype(np.float32)
    for low in range(0, len(one.top), TILE):
        far = np.float32(tx.radius[min(low + TILE, tx.n_top) - 1]) + wide
        a, b = np.nonzero(one.top[low : low + TILE] @ two.top.T >= np.float32(1 - SLACK) - far * far / 2)
        found.append((a + low, b))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all values first[i] <= value < last[i]."""
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[owner]


def _product(owner_a, value_a, owner_b, value_b, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner, all pairs of its values in a and in b, both sorted by owner."""
    count_a, count_b = np.bincount(owner_a, minlength=n), np.bincount(owner_b, minlength=n)
    first_b = np.cumsum(count_b) - count_b
    k, v = _ranges(first_b[owner_a], (first_b + count_b)[owner_a])
    return value_a[k], value_b[v]


def dual_traversal(one: Block, two: Block | None, groups: Groups, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of two blocks, or among those of one. For each row of one, and of two, the weight of its partners. groups,
    of one's rows and then two's, is told the links. A pair of nodes that is whole tells them by its first rows."""
    same = two is None
    two = one if same else two
    tx, ty, base = one.tree, two.tree, 0 if same else len(one.x)
    gain_x, gain_y = np.zeros(len(one.x) + 1, dtype=np.int64), np.zeros(len(two.x) + 1, dtype=np.int64)  # differences along the rows
    reach = np.sqrt(2 - 2 * min_cosine)

    a, b = _top_pairs(one, two, reach)
    if same:
        a, b = a[a <= b], b[a <= b]
    todo = [(a[s : s + PAIRS], b[s : s + PAIRS]) for s in range(0, len(a), PAIRS)]
    while todo:
        a, b = todo.pop()
        d = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", one.x[tx.centre[a]], two.x[ty.centre[b]])))
        both = tx.radius[a] + ty.radius[b]
        near = d <= both + reach + SLACK
        a, b, d, both = a[near], b[near], d[near], both[near]
        size_a, size_b = tx.end[a] - tx.start[a], ty.end[b] - ty.start[b]
        single = (size_a == 1) & (size_b == 1)
        itself = (a == b) if same else np.zeros(len(a), dtype=bool)
        whole = (d + both <= reach - SLACK) & ~single
        # a node with itself: all its pairs are closer than twice its radius
        whole = np.where(itself, (2 * tx.radius[a] <= reach - SLACK) & (size_a > 1), whole)
        wa, wb, wi = a[whole], b[whole], itself[whole]
        if len(wa):
            sa, ea, sb, eb = tx.start[wa], tx.end[wa], ty.start[wb], ty.end[wb]
            np.add.at(gain_x, sa, two.sum[eb] - two.sum[sb])
            np.subtract.at(gain_x, ea, two.sum[eb] - two.sum[sb])
            np.add.at(gain_y, sb[~wi], (one.sum[ea] - one.sum[sa])[~wi])
            np.subtract.at(gain_y, eb[~wi], (one.sum[ea] - one.sum[sa])[~wi])
            _, own = _ranges(sa[wi], ea[wi])  # a row isn't its own partner
            np.subtract.at(gain_x, own, one.weight[own])
            np.add.at(gain_x, own + 1, one.weight[own])
            k, rows = _ranges(sa, ea)
            groups.join(rows, base + sb[k])
            k, rows = _ranges(sb, eb)
            groups.join(base + rows, sa[k])
        leaf = ((tx.first[a] == tx.last[a]) & (ty.first[b] == ty.last[b])) & ~whole
        if leaf.any():  # single rows, or small leaves: their rows are compared
            la, lb = a[leaf], b[leaf]
            # leaves of many rows are taken a few at a time
            work = np.cumsum((tx.end[la] - tx.start[la]) * (ty.end[lb] - ty.start[lb])) // PAIRS
            for part in np.split(np.arange(len(la)), np.flatnonzero(np.diff(work)) + 1):
                pa_, pb_ = la[part], lb[part]
                p, q = _product(*_ranges(tx.start[pa_], tx.end[pa_]), *_ranges(ty.start[pb_], ty.end[pb_]), len(part))
                if same:
                    twin = np.repeat(pa_ == pb_, (tx.end[pa_] - tx.start[pa_]) * (ty.end[pb_] - ty.start[pb_]))
                    fit = np.where(twin, p < q, p != q)
                    p, q = p[fit], q[fit]
                for s in range(0, len(p), PAIRS):
                    u, v = p[s : s + PAIRS], q[s : s + PAIRS]
                    fit = np.einsum("ij,ij->i", one.raw[u], two.raw[v]) / (one.norm[u] * two.norm[v]) >= min_cosine
                    u, v = u[fit], v[fit]
                    for gain, rows, w in ((gain_x, u, two.weight[v]), (gain_x if same else gain_y, v, one.weight[u])):
                        np.add.at(gain, rows, w)
                        np.subtract.at(gain, rows + 1, w)
                    groups.join(u, base + v)
        # split the wider of the two, or the one that can be split
        rest = ~whole & ~leaf
        a, b, itself = a[rest], b[rest], itself[rest]
        can_a, can_b = tx.first[a] < tx.last[a], ty.first[b] < ty.last[b]
        split_a = can_a & (~can_b | (tx.radius[a] >= ty.radius[b]))
        split_b = can_b & (~can_a | (ty.radius[b] > tx.radius[a]))
        fa, ea = np.where(split_a | itself, tx.first[a], a), np.where(split_a | itself, tx.last[a], a + 1)
        fb, eb = np.where(split_b | itself, ty.first[b], b), np.where(split_b | itself, ty.last[b], b + 1)
        na, nb = _product(*_ranges(fa, ea), *_ranges(fb, eb), len(a))
        if same:  # a node met itself: its children's pairs come twice
            k = np.repeat(itself, (ea - fa) * (eb - fb))
            na, nb = na[~k | (na <= nb)], nb[~k | (na <= nb)]
        todo += [(na[s : s + PAIRS], nb[s : s + PAIRS]) for s in range(0, len(na), PAIRS)]
    return np.cumsum(gain_x + gain_y if same else gain_x)[:-1], np.cumsum(gain_y)[:-1]


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Vectors whose squares could leave the doubles are scaled by their largest component; the cosine stays."""
    top = np.abs(rows).max(axis=1, keepdims=True)
    return np.where((top > 1e100) | (top < 1e-100), rows / np.where(top > 0, top, 1), rows)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _stacked(vec: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    return _scaled(vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1))


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension: unit vectors of at most MAX_PIVOTS rows, those with the least hashes."""
    rows = vectors.orderBy(F.xxhash64("vec"), "uid").limit(MAX_PIVOTS).select("vec").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["vec"]), []).append(r["vec"])
    return {n: _unit(_scaled(np.array(v, dtype=np.float64))) for n, v in by.items()}


def _celled(vectors: DataFrame, n_pivots: int) -> tuple[DataFrame, dict]:
    """uid, weight, vec, dim, cell (nearest pivot), away (distance to it); and the pivots by (dim, cell). Dimensions without a pivot are
    one cell without a bound."""
    pivots = {n: p[:n_pivots] for n, p in _pivots(vectors).items()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            dims = vec.value_lengths().to_numpy()
            cell, away = np.zeros(len(dims), dtype=np.int32), np.full(len(dims), 2.0)
            for n in np.unique(dims).tolist():
                if n in pivots:
                    at = np.flatnonzero(dims == n)
                    cos = _unit(_stacked(vec.take(pa.array(at)))) @ pivots[n].T
                    cell[at] = cos.argmax(axis=1)
                    away[at] = np.sqrt(np.maximum(0, 2 - 2 * cos.max(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("weight"), vec, pa.array(dims, pa.int32()), pa.array(cell), pa.array(away)], names=["uid", "weight", "vec", "dim", "cell", "away"])

    schema = f"uid long, weight long, vec {dict(vectors.dtypes)['vec']}, dim int, cell int, away double"
    return vectors.mapInArrow(of, schema), {(n, c): p for n, ps in pivots.items() for c, p in enumerate(ps)}


def _layout(cells: list, centres: dict, block: int, min_cosine: float) -> tuple[list, list]:
    """cells: dim, cell, n, radius; at most MAX_PIVOTS for a dimension. Rows (dim, cell, number, parts, first block), and pairs
    (number a, number b), a <= b, of cells that may hold a link."""
    rows, at = [], 0
    for k, r in enumerate(cells):
        parts = -(-r["n"] // max(64, min(block, BLOCK_VALUES // max(1, r["dim"]))))
        rows.append((r["dim"], r["cell"], k, parts, at))
        at += parts
    reach, pairs = float(np.sqrt(2 - 2 * min_cosine)), []
    by: dict[int, list[int]] = {}
    for k, r in enumerate(cells):
        by.setdefault(r["dim"], []).append(k)
    for dim, own in by.items():
        known = all((dim, cells[k]["cell"]) in centres for k in own)
        if known:
            c, radius = np.stack([centres[(dim, cells[k]["cell"])] for k in own]), np.array([cells[k]["radius"] for k in own])
            away = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
            a, b = np.nonzero(away <= radius[:, None] + radius + reach + SLACK)
        else:
            a, b = np.nonzero(np.ones((len(own), len(own)), dtype=bool))
        pairs += [(own[i], own[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i <= j]
    return rows, pairs


def _by_run(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """The rows of a sorted partition, all rows of one value of `name` at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(name).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if held and held[-1].column(name)[0].as_py() != keys[low]:
                yield pa.Table.from_batches(held)
                held = []
            if high > low:
                held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


#: A row of what is found: the block's data, and (uid, n) of partners or (uid, other) of a link.
FOUND = "block int, data binary, uid long, n long, other long"


def _found(uid=(), n=(), other=(), block=None, data=None) -> pa.RecordBatch:
    rows = max(1 if data is not None else 0, len(uid))
    none = [None] * rows
    columns = [pa.array([block] * rows, pa.int32()), pa.array([data] if data is not None else none, pa.binary()), *[pa.array(c if len(c) else none, pa.int64()) for c in (uid, n, other)]]
    return pa.RecordBatch.from_arrays(columns, names=["block", "data", "uid", "n", "other"])


def _counted(uid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return _found(uid[n > 0], n[n > 0])


def _trees(placed: DataFrame, n_blocks: int, min_cosine: float) -> DataFrame:
    """placed: uid, weight, vec, block. FOUND rows: each block's data (its uids, each one's group in it, the packed block), and the
    partners and groups that it has inside."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_run(batches, "block"):
            own = Block(_stacked(rows.column("vec").combine_chunks()), rows.column("weight").to_numpy())
            uid, groups = rows.column("uid").to_numpy()[own.tree.order], Groups(len(rows))
            n, _ = dual_traversal(own, None, groups, min_cosine)
            yield _found(block=rows.column("block")[0].as_py(), data=np.int64(len(uid)).tobytes() + uid.tobytes() + groups.name.tobytes() + own.packed())
            yield _counted(uid, n)
            joined = groups.name != np.arange(len(uid))
            yield _found(uid[joined], other=uid[groups.name[joined]])

    dealt = placed.repartitionById(max(1, min(n_blocks, MAX_TASKS)), F.col("block") % MAX_TASKS).sortWithinPartitions("block", "uid")
    return dealt.select("uid", "weight", "vec", "block").mapInArrow(build, FOUND)


def _crossed(trees: DataFrame, pairs: DataFrame, n_blocks: int, min_cosine: float) -> DataFrame:
    """trees: block, data; pairs: a, b (blocks). FOUND rows of partners and links between different blocks."""
    side = -(-n_blocks // TILE_BLOCKS)
    ta, tb = F.expr(f"a div {TILE_BLOCKS}"), F.expr(f"b div {TILE_BLOCKS}")
    # the tiles of the upper triangle, numbered row by row
    tiled = pairs.withColumn("tile", (ta * side - F.expr(f"(a div {TILE_BLOCKS}) * ((a div {TILE_BLOCKS}) - 1) div 2") + tb - ta).cast("long"))
    n_tasks = max(1, min(side * (side + 1) // 2, MAX_TASKS))
    # each block that a tile needs, with its partners there, of which there are TILE_BLOCKS at most
    left = tiled.groupBy("tile", F.col("a").alias("block")).agg(F.sort_array(F.collect_list("b")).alias("partners"))
    right = tiled.select("tile", F.col("b").alias("block"), F.array().cast("array<int>").alias("partners")).distinct()
    needed = left.unionByName(right).groupBy("tile", "block").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    needed = stored(needed, "cover_tiles")
    dealt = needed.join(trees, "block").select("tile", "block", "partners", "data")
    dealt = dealt.repartitionById(n_tasks, (F.col("tile") % n_tasks).cast("int")).sortWithinPartitions("tile", "block")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_run(batches, "tile"):
            blocks, names, uids, gains, partners = {}, {}, {}, {}, {}
            for block, own, data in zip(rows.column("block").to_pylist(), rows.column("partners").to_pylist(), rows.column("data"), strict=True):
                data = data.as_buffer()
                n = int(np.frombuffer(data, "<i8", 1)[0])
                uids[block], names[block] = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
                blocks[block], gains[block], partners[block] = Block.unpacked(data[8 + 16 * n :]), np.zeros(n, dtype=np.int64), own
            for a, others in partners.items():
                for b in others:
                    n = len(uids[a])
                    groups = Groups(n + len(uids[b]))
                    groups.name = np.concatenate([names[a], n + names[b]])
                    before = groups.name.copy()
                    to_a, to_b = dual_traversal(blocks[a], blocks[b], groups, min_cosine)
                    gains[a] += to_a
                    gains[b] += to_b
                    # only groups of the blocks that have come together are told
                    both, moved = np.concatenate([uids[a], uids[b]]), np.flatnonzero((groups.name != before) & (before == np.arange(len(before))))
                    if len(moved):
                        yield _found(both[moved], other=both[groups.name[moved]])
            for block, n in gains.items():
                yield _counted(uids[block], n)

    return dealt.mapInArrow(cross, FOUND)


def vector_links(vectors: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """vectors: uid (long), weight (long), vec (array of float or double, neither zero nor with null or non-finite components).

    A table of rows (uid, n, other): with n, a part of the weight of uid's partners; with other, a vector that links join uid to,
    directly or by way of others. Such rows are fewer than the vectors, and than the groups that each pair of blocks joins."""
    spark, total = vectors.sparkSession, vectors.count()
    if not total:
        return spark.createDataFrame([], "uid long, n long, other long")
    block = min(block, max(SMALL_BLOCK, -(-total // 16)))
    # about one cell to a block: many blocks from few pivots, few from few vectors
    celled, centres = _celled(vectors, max(1, min(MAX_PIVOTS, -(-total // block))))
    celled = stored(celled, "cover_cells")
    cells = celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).orderBy("dim", "cell").collect()
    rows, near = _layout(cells, centres, block, min_cosine)
    n_blocks = sum(r[3] for r in rows)
    # tables of the cells, of which there is a fixed number
    table = spark.createDataFrame(rows, "dim int, cell int, number int, parts int, first int")
    near_cells = spark.createDataFrame(near, "x int, y int")
    # a block's rows are the members of its cell that hash to its part
    placed = celled.join(F.broadcast(table), ["dim", "cell"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    inside = stored(_trees(placed, n_blocks, min_cosine), "cover_trees")
    blocks = stored(table.select("number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("block")), "cover_blocks")
    pairs = blocks.join(F.broadcast(near_cells), F.col("number") == F.col("x")).select(F.col("block").alias("a"), "y")
    pairs = pairs.join(blocks.select(F.col("number").alias("y"), F.col("block").alias("b")), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.filter("a < b").distinct()
    between = stored(_crossed(inside.filter("data IS NOT NULL").select("block", "data"), pairs, n_blocks, min_cosine), "cover_links")
    emptied(celled, blocks)
    return inside.filter("data IS NULL").unionByName(between).filter("uid IS NOT NULL").select("uid", "n", "other")


def near_vectors(embeddings: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, for each row of embeddings.

    n_links: rows at a cosine of min_cosine or more, the row itself left out. component_id: the least vec_id that links reach, itself
    included. kept: vec_id = component_id. Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing, as do vectors of different lengths. Equal vectors are handled as one that counts as many. A row with a null id links
    like any other; it names a component only if that has no other id (then null). Rows that repeat are vectors of their own. An
    empty table gives an empty table. Other columns aren't read."""
    own = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    fit = F.coalesce((F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False))
    own = own.withColumn("vec", F.when(fit, F.col("vec")))
    # equal vectors share 128 bits of hash, by which rows find their vector again
    own = own.withColumns({"h1": F.when(fit, F.xxhash64("vec")), "h2": F.when(fit, F.xxhash64(F.lit(1), "vec"))})
    distinct = own.filter(F.col("vec").isNotNull()).groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    # numbered once, as it is written, so that every later read sees the same numbers
    distinct = stored(distinct.withColumn("uid", F.monotonically_increasing_id()), "cover_vectors")
    found = vector_links(distinct.select("uid", "weight", "vec"), min_cosine, block)
    partners = found.filter(F.col("n").isNotNull()).groupBy("uid").agg(F.sum("n").alias("n"))
    parts = components(found.filter(F.col("other").isNotNull()).select(F.col("uid").alias("a"), F.col("other").alias("b")), "cover_components")
    named = distinct.select("uid", "h1", "h2", "weight", "least").join(parts.withColumnRenamed("node", "uid"), "uid", "left").join(partners, "uid", "left")
    named = stored(named.select("h1", "h2", "weight", "least", "n", F.coalesce("component", "uid").alias("part")), "cover_named")
    least = stored(named.groupBy("part").agg(F.min("least").alias("component_id")), "cover_least")
    named = named.join(least, "part").select("h1", "h2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = own.filter(F.col("h1").isNotNull()).select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = own.filter(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
