"""Nearest dense vectors by cosine: exact, in cells around pivots, of which those that can't hold a result are not multiplied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsim.sources.tables import written

#: Vectors of a block of the base, and of the queries.
BASE_BLOCK = 8192
QUERY_BLOCK = 2048
#: Cells at most, vectors of a cell below that bound, and vectors of the sample from which their pivots are chosen, for each cell.
MAX_CELLS, CELL, SAMPLE = 256, 2048, 4
SLACK = 1e-9


def _unit(vectors: list) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    # divided by the largest component first, so that squares of large ones don't overflow
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec, dim of the vectors that can match anything."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fit = (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    return own.filter(F.coalesce(fit, F.lit(False))).withColumn("dim", F.size("vec"))


def _pivots(base: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Unit vectors around which the cells lie, by dimension, chosen from a sample of bounded size, each far from those before it. They say which cell a vector
    falls into, never the result."""
    by: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("id"), "id").limit(n * SAMPLE).select("vec", "dim").collect():
        by.setdefault(r["dim"], []).append(r["vec"])
    chosen = {}
    for dim, vectors in by.items():
        x = _unit(vectors)
        picked, near = [0], x @ x[0]
        while len(picked) < min(n, len(x)) and near.min() < 1 - 1e-6:
            picked.append(int(near.argmin()))
            near = np.maximum(near, x @ x[picked[-1]])
        chosen[dim] = x[picked]
    return chosen


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _celled(base: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """id, vec, dim, cell (that of the nearest pivot; -1 for a dimension without one), angle to the pivot."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, same in batch.groupby("dim"):
                same = same.assign(cell=-1, angle=np.pi)
                if dim in pivots:
                    cosine = _unit(same["vec"].to_list()) @ pivots[dim].T
                    same["cell"] = cosine.argmax(axis=1)
                    same["angle"] = _angle(cosine.max(axis=1))
                yield same

    return base.mapInPandas(place, "id long, vec array<double>, dim int, cell int, angle double")


def _sent(queries: DataFrame, pivots: dict[int, np.ndarray], cells: dict[int, dict[int, tuple[int, float]]], k: int, places: int) -> DataFrame:
    """queries: id, vec, dim and, in the second round, bound. id, vec, dim, cell: where each query goes. Without a bound, to the nearest cells that hold k
    vectors together; with one, to the other cells in which a vector may reach it."""
    second = "bound" in queries.columns

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, same in batch.groupby("dim"):
                if dim not in cells:
                    continue
                known = sorted(cells[dim])
                if dim in pivots:
                    angle = _angle(_unit(same["vec"].to_list()) @ pivots[dim][known].T)
                else:
                    angle = np.zeros((len(same), len(known)))
                radius, size = (np.array([cells[dim][c][i] for c in known]) for i in (1, 0))
                # whole cells, nearest pivot first, until they hold k vectors
                order = np.argsort(angle, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1) - size[order]
                first = np.zeros(angle.shape, dtype=bool)
                np.put_along_axis(first, order, held < k, axis=1)
                if second:
                    # rounded scores are compared
                    least = same["bound"].to_numpy() - 0.5 * 10.0**-places - SLACK
                    first = ~first & (np.cos(np.maximum(angle - radius - SLACK, 0)) >= least[:, None])
                row, cell = np.nonzero(first)
                yield pd.DataFrame({"id": same["id"].to_numpy()[row], "vec": same["vec"].to_numpy()[row], "dim": dim, "cell": np.array(known)[cell]})

    return queries.mapInPandas(send, "id long, vec array<double>, dim int, cell int")


def _multiplied(sent: DataFrame, base: DataFrame, k: int, places: int) -> DataFrame:
    """query_id, vec_id, score: of each query and block that it goes to, the k best of positive cosine. A cell is cut into blocks of bounded size, and so are
    its queries; a block is copied only for queries that don't fit into one, and vectors of cells that no query goes to stay where they are."""
    asked = sent.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("asked"))
    cells = base.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("held")).join(asked, ["dim", "cell"])
    # a row for each cell, of which there is a bounded number
    cells = written(cells.select("dim", "cell", F.ceil(F.col("held") / BASE_BLOCK).alias("parts"), F.ceil(F.col("asked") / QUERY_BLOCK).alias("chunks")), "dense_tiles")

    def dealt(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        spread = df.select("id", "vec", "dim", "cell").join(F.broadcast(cells), ["dim", "cell"])
        spread = spread.withColumn("own", F.pmod(F.xxhash64("id"), F.col(own))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        part, chunk = ("other", "own") if side == 0 else ("own", "other")
        return spread.select("dim", "cell", F.col(part).alias("part"), F.col(chunk).alias("chunk"), F.lit(side).alias("side"), "id", "vec")

    both = dealt(sent, "chunks", "parts", 0).unionByName(dealt(base, "parts", "chunks", 1))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        side, ids = pdf["side"].to_numpy(), pdf["id"].to_numpy()
        if (side == 0).any() and (side == 1).any():
            x = _unit(pdf["vec"].to_list())
            q, c, qid, cid = x[side == 0], x[side == 1], ids[side == 0], ids[side == 1]
            c, cid = c[np.argsort(cid, kind="stable")], np.sort(cid)
            for low in range(0, len(q), 256):
                score = np.round(q[low : low + 256] @ c.T, places)
                # ids ascend, so a stable sort by score breaks ties by id
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(score, order, axis=1)
                keep = value > 0
                out.append(pd.DataFrame({"query_id": np.repeat(qid[low : low + 256], order.shape[1])[keep.ravel()], "vec_id": cid[order][keep], "score": value[keep]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return both.groupBy("dim", "cell", "part", "chunk").applyInPandas(best, "query_id long, vec_id long, score double")


def embedding_top_k(queries: DataFrame, vectors: DataFrame, k: int = 6, id_col: str = "vec_id", vec_col: str = "embedding", places: int = 6, cells: int | None = None) -> DataFrame:
    """query_id, vec_id, score (rounded), rank: for each query vector the k best vectors of positive cosine, by rounded score and id.

    The base lies in cells around pivots, which are written once. A query first goes to the nearest cells; the k-th best score found there is a bound, and then it
    goes only to those other cells whose distance and radius leave room for a vector at the bound. In data without clusters those may be all. Vectors
    that are null, empty or zero, or hold null or non-finite components, and those of another length than the query's, match nothing."""
    asked, own = _usable(queries, id_col, vec_col), _usable(vectors, id_col, vec_col)
    n = cells or max(1, min(MAX_CELLS, own.count() // CELL))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def cut(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    if n == 1:
        # each query goes everywhere
        return cut(_multiplied(*[df.withColumn("cell", F.lit(0)) for df in (asked, own)], k, places))
    asked, pivots = written(asked, "dense_queries"), _pivots(own, n)
    base = written(_celled(own, pivots), "dense_cells")
    sizes: dict[int, dict[int, tuple[int, float]]] = {}
    for r in base.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect():
        sizes.setdefault(r["dim"], {})[r["cell"]] = (r["n"], r["radius"])
    first = written(cut(_multiplied(written(_sent(asked, pivots, sizes, k, places), "dense_near"), base, k, places)), "dense_first")
    bound = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    # without k results any positive score may be one
    again = asked.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    far = written(_sent(again, pivots, sizes, k, places), "dense_far")
    return cut(first.drop("rank").unionByName(_multiplied(far, base, k, places)))
