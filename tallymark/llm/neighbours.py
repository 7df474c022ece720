"""Nearest neighbours by inner product, from a few stable projections in a kd-tree.

Vectors get one more component that makes all of them equally long, so the largest inner product
is the smallest distance.  Gaussian projections to ``DIMS`` numbers are an index: the squared
projected distance of a vector at distance ``d`` is ``d * d`` times a chi-square variable.
A kd-tree cuts the projected space into cells; its upper part is fitted on a bounded sample of
``SAMPLE`` rows, every row is filed in it, and every cell has the rest of the tree inside.

A search takes the projected neighbours in order of their distance, some leaves at a time, and verifies
them on the original vectors; all queries that take a leaf in the same round share one matrix product.  It ends, for each query, when the chi-square test holds: when a vector
nearer than the last of the ``k`` found would show so large a projected distance with a chance of
``1 - CONFIDENCE`` only.  So every true neighbour is found with a chance of ``CONFIDENCE`` at least.  The
cell a query falls in is searched first; its result bounds which other cells the query has to visit.

Queries meet cells in blocks of bounded size on both sides; a cell is copied once for every ``QUERIES_AT_ONCE`` queries
that visit it, not for those that do not.  Of equal vectors only the ``k + 1`` smallest ids can be
among the ``k`` nearest (ties go to smaller ids), so the others are found without being filed.

* vectors that are null, empty, zero, or hold null or non-finite components take no part; neither do those with a null id
* vectors of another size than the most frequent one (the smaller, if tied) take no part
* fewer than ``k`` candidates: all of them; an empty table, or no queries: an empty result
* repeated rows are one; rows with equal ids are one candidate, with the largest of its scores; a query never finds its own id
* other columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.scratch import written

K = 20
DIMS = 12
CONFIDENCE = 0.95
SAMPLE = 50_000
#: Rows in a cell, aimed at; and so many queries meet a cell at once.
CELL_ROWS = 8192
QUERIES_AT_ONCE = 8192
LEAF_ROWS = 64
LEAVES_AT_ONCE = 8
#: Pairs of vectors whose exact scores are taken at once.
PAIRS_AT_ONCE = 100_000
#: Queries whose distances to all cells are taken at once.
BOXES_AT_ONCE = 256
SEED = 7


def chi_square(confidence: float, dims: int) -> float:
    """Quantile of the chi-square distribution (cube-root approximation)."""
    part = 2 / (9 * dims)
    return dims * (1 - part + NormalDist().inv_cdf(confidence) * part**0.5) ** 3


def _leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree: halves along the widest side, down to ``most`` rows."""
    todo, done = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        own = points[rows]
        side = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(rows) else 0
        if len(rows) <= most or own[:, side].max() == own[:, side].min():
            done.append(rows)
            continue
        order = np.argsort(own[:, side], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


@dataclass(frozen=True)
class Space:
    """Projection and the upper part of the kd-tree as nested splits ``(side, value, below, above)`` or a cell number."""

    matrix: np.ndarray  # components and the added one, by dims
    longest: float  # largest squared length
    splits: object = 0
    cells: int = 1

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(0.0, self.longest - np.einsum("ij,ij->i", vectors, vectors)))
        return vectors @ self.matrix[:-1] + extra[:, None] * self.matrix[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.matrix[:-1]

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int32)
        todo = [(self.splits, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, tuple):
                side, value, below, above = node
                low = points[rows, side] < value
                todo += [(below, rows[low]), (above, rows[~low])]
            else:
                out[rows] = node
        return out

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corner of each cell."""
        dims = self.matrix.shape[1]
        low, high = np.full((self.cells, dims), -np.inf), np.full((self.cells, dims), np.inf)
        todo = [(self.splits, np.full(dims, -np.inf), np.full(dims, np.inf))]
        while todo:
            node, a, b = todo.pop()
            if isinstance(node, tuple):
                side, value, below, above = node
                middle_b, middle_a = b.copy(), a.copy()
                middle_b[side] = middle_a[side] = value
                todo += [(below, a, middle_b), (above, middle_a, b)]
            else:
                low[node], high[node] = a, b
        return low, high


def _split(points: np.ndarray, cells: int) -> tuple[object, int]:
    number = 0

    def cut(own: np.ndarray, wanted: int) -> object:
        nonlocal number
        side = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) > 1 else 0
        value = float(np.median(own[:, side])) if len(own) else 0.0
        low = own[:, side] < value
        if wanted < 2 or not low.any() or low.all():
            number += 1
            return number - 1
        return side, value, cut(own[low], wanted // 2), cut(own[~low], wanted - wanted // 2)

    return cut(points, cells), number


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


class Cell:
    """Rows of a cell with their kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        leaves = _leaves(points, LEAF_ROWS)
        order = np.concatenate(leaves)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.edges = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def search(self, own: np.ndarray, asked: np.ndarray, points: np.ndarray, bound: np.ndarray, longest: float, quantile: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ids and scores of the best ``k`` of each query with a score of at least its ``bound``."""
        base = np.einsum("ij,ij->i", asked, asked) + longest  # less twice the score it is the squared distance
        room = 1e-9 * base  # products of whole blocks differ from exact scores by rounding
        bound = bound.copy()
        near = np.zeros((len(asked), len(self.low)))
        for side in range(points.shape[1]):
            gap = np.maximum(self.low[:, side] - points[:, side : side + 1], points[:, side : side + 1] - self.high[:, side])
            near += np.square(np.maximum(0.0, gap))
        order = np.argsort(near, axis=1, kind="stable")
        pool = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        active = np.arange(len(asked))
        for at in range(0, order.shape[1], LEAVES_AT_ONCE):
            stop = np.where(bound > -np.inf, (np.maximum(0.0, base - 2 * bound) + room) * quantile, np.inf)
            active = active[near[active, order[active, at]] <= stop[active]]
            if not len(active):
                break
            some = order[active, at : at + LEAVES_AT_ONCE]
            who, leaf = np.repeat(active, some.shape[1]), some.ravel()
            taken = near[who, leaf] <= stop[who]
            who, leaf = who[taken], leaf[taken]
            by_leaf = np.argsort(leaf, kind="stable")
            who, leaf = who[by_leaf], leaf[by_leaf]
            starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            parts = [pool]
            for a, b in zip(starts, np.r_[starts[1:], len(leaf)], strict=True):
                q, rows = who[a:b], np.arange(self.edges[leaf[a]], self.edges[leaf[a] + 1])
                scores = asked[q] @ self.vectors[rows].T
                i, j = np.nonzero((scores >= (bound[q] - room[q])[:, None]) & (self.ids[rows] != own[q][:, None]))
                parts.append((q[i], rows[j], scores[i, j]))
            q, rows, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
            best = np.lexsort((-scores, q))
            q, rows, scores = q[best], rows[best], scores[best]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
            last = np.diff(np.r_[first, len(q)]) >= k
            kth = first[last] + k - 1
            bound[q[kth]] = np.maximum(bound[q[kth]], scores[kth])
            keep = scores >= bound[q] - room[q]
            pool = q[keep], rows[keep], scores[keep]
        q, rows, _ = pool
        scores = np.empty(len(q))
        for a in range(0, len(q), PAIRS_AT_ONCE):
            at = slice(a, a + PAIRS_AT_ONCE)
            scores[at] = (self.vectors[rows[at]] * asked[q[at]]).sum(axis=1)  # the same in whatever order rows stand
        ids = self.ids[rows]
        best = np.lexsort((ids, -scores, q))
        q, ids, scores = q[best], ids[best], scores[best]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        top = rank < k
        return own[q[top]], ids[top], scores[top]


def _searched(space: Space, size: int, quantile: float, k: int):
    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if queries.num_rows and rows.num_rows:
            vectors = _matrix(rows.column("v"), size)
            cell = Cell(rows.column("vec_id").to_numpy(), vectors, space.rows(vectors))
            asked = _matrix(queries.column("v"), size)
            found = cell.search(queries.column("query_id").to_numpy(), asked, space.queries(asked), queries.column("bound").to_numpy(), space.longest, quantile, k)
        return pa.table([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, vec_id long, score double"


def fit_space(rows: DataFrame, size: int, count: int, dims: int, cell_rows: int) -> Space:
    """Projection and cells from at most ``SAMPLE`` rows ``(vec_id, v)``, chosen by hash."""
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    matrix = np.random.default_rng(SEED).standard_normal((size + 1, dims))
    flat = Space(matrix, float(longest))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).select("v").toArrow()
    splits, cells = _split(flat.rows(_matrix(sample.column("v"), size)), max(1, min(count // cell_rows, SAMPLE // 8)))
    return Space(matrix, float(longest), splits, cells)


def nearest(vectors: DataFrame, queries: Column, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors (vec_id, embedding)`` that fit ``queries``."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    valid = vectors.where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asked"))
    valid = written(valid, "vectors")
    sizes = valid.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    size = sizes["size"]
    valid = valid.where(F.size("v") == size)
    alike = Window.partitionBy("v").orderBy("vec_id")
    rows = written(valid.select("vec_id", "v").distinct().withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k + 1).drop("nth"), "candidates")
    n = rows.count()
    space, quantile = fit_space(rows, size, n, dims, cell_rows), chi_square(confidence, dims)
    # more rows than the cells aim at are dealt into parts
    parts = -(-n // (2 * cell_rows * space.cells))

    def file(of, wanted: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column(wanted, pa.array(space.cell(of(_matrix(batch.column("v"), size)))))

        return run

    filed = rows.mapInArrow(file(space.rows, "cell"), "vec_id long, v array<double>, cell int")
    filed = filed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    asking = valid.where("asked").select(F.col("vec_id").alias("query_id"), "v")
    key = ["cell", "part", "block"]

    def search(wanted: DataFrame) -> DataFrame:
        # a number for each cell: at most SAMPLE / 8 of them, whatever the table
        visits = {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        last = F.lit([max(0, -(-visits.get(c, 0) // QUERIES_AT_ONCE) - 1) for c in range(space.cells)])[F.col("cell")]
        seen = F.lit([c in visits for c in range(space.cells)])[F.col("cell")]
        there = filed.where(seen).withColumn("block", F.explode(F.sequence(F.lit(0), last.cast("int"))))
        block = F.pmod(F.xxhash64("query_id", F.lit(3)), last + 1).cast("int")
        each = wanted.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return each.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(_searched(space, size, quantile, k), FOUND)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    home = asking.mapInArrow(file(space.queries, "cell"), "query_id long, v array<double>, cell int").withColumn("bound", F.lit(float("-inf")))
    at_home = written(search(home), "home")
    first = best(at_home).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = asking.join(first, "query_id", "left").fillna(float("-inf"), ["bound"])
    low, high = space.boxes()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = _matrix(batch.column("v"), size)
            bound, points = batch.column("bound").to_numpy(), space.queries(asked)
            base = np.einsum("ij,ij->i", asked, asked) + space.longest
            stop = np.where(bound > -np.inf, (np.maximum(0.0, base - 2 * bound) + 1e-9 * base) * quantile, np.inf)
            for a in range(0, len(points), BOXES_AT_ONCE):
                some = points[a : a + BOXES_AT_ONCE, None, :]
                gap = np.square(np.maximum(0.0, np.maximum(low - some, some - high))).sum(axis=2)
                who, cells = np.nonzero(gap <= stop[a : a + BOXES_AT_ONCE, None])
                yield batch.take(pa.array(who + a)).append_column("cell", pa.array(cells.astype(np.int32)))

    wanted = bounded.select("query_id", "v", "bound").mapInArrow(visits, "query_id long, v array<double>, bound double, cell int")
    return best(at_home.unionByName(search(wanted))).select("query_id", "rank", "vec_id", "score")
