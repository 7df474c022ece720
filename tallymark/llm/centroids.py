"""Centroid clustering with bounds that are loosened by geometry.

Lloyd's rounds over whole-number vectors, with Hamerly's two bounds for each vector: ``u``, at least the
distance to its own centroid, and ``l``, at most the distance to any other.  When centroids move, ``u`` grows
by the own centroid's move.  ``l`` need not shrink by the largest move of another centroid: the members of
cluster i lie in a sphere around its centroid, whose radius is the largest ``u`` among them.  In the
half-plane of the line through another centroid's old and new place and of the sphere's centre, the points whose
distance to the moving centroid falls by a given amount lie on a branch of a hyperbola, which stays between its
asymptotes through the middle of the move.  So over the sphere the distance falls by no more than the length of the
move times the cosine of the smallest angle, seen from that middle, between the move and a point of the sphere
(:func:`loosening`).  ``l`` shrinks by the largest such amount over the other centroids.  A vector
with ``u`` below ``l`` or below half the way from its centroid to the next one keeps its centroid unseen; ``u`` is
then tightened to the true distance, and vectors that are still ambiguous are compared with all centroids, exactly.

All that decides is exact: vectors and centroids are integers, distances and sums are summed in 64 bits, and
bounds carry a margin against rounding, so a tie is always ambiguous and goes to the smaller number.

A round is one pass: it reads the vectors with their bounds, writes them with new ones, and its tasks add one row
per cluster (count, sums, largest ``u``).  These rows, a few a task, are summed up by Spark; the driver gets one
number per cluster and dimension.  Each round's table is written to the shared folder and the one before deleted, so a lost
executor costs its tasks of one round.  Nothing depends on the sizes of clusters or on how vectors are dealt.

* vectors that are null, of another length, or that hold a null or non-finite component take no part; nor do
  those with a component of ``LARGEST`` units or more, whose distances might not fit into a long
* a null id is a vector like any other, its key is that of the empty string; repeated rows count each
* ties at the start (equal ids) go by components; with fewer vectors than ``k`` there are as many clusters; an
  empty table gives no rows
* other columns are ignored, whatever their names
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.scratch import discard, fresh_path, written

K, ROUNDS, DIMENSIONS, UNITS = 8, 10, 64, 1024
#: Beyond it in units, a component may make a squared distance of 64 dimensions pass a long.
LARGEST = 1 << 27
#: Up to it, products are exact in double precision: 64 * (2 ** 22) ** 2 is below 2 ** 53.
EXACT = 1 << 22
#: Vectors compared at once.
BLOCK = 4_096
#: Relative and absolute room that bounds leave for rounding.
ROOM = 1e-9

STATE = "vec_id long, v array<int>, cluster int, u double, l double, distance long, part boolean, n long, sums array<long>, scanned long"


@dataclass
class Clustering:
    """``assigned (vec_id, cluster, distance)``, the final centroids, and the vectors compared with all centroids in each pass."""

    assigned: DataFrame
    centroids: np.ndarray
    scanned: list[int] = field(default_factory=list)


def whole(vectors: DataFrame, dimensions: int = DIMENSIONS, units: int = UNITS) -> DataFrame:
    """``vec_id, v``: usable vectors in whole units, rounded down."""
    x = F.transform("embedding", lambda c: c.cast("double") * units)
    fits = (F.size("embedding") == dimensions) & F.forall("x", lambda c: c.isNotNull() & (c > -LARGEST) & (c < LARGEST))
    kept = vectors.select("vec_id", "embedding", x.alias("x")).where(F.col("embedding").isNotNull() & F.coalesce(fits, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("x", lambda c: F.floor(c).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = 3) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], dtype=np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and x.shape[1] <= 64:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        # x.x + c.c - 2 x.c is a sum of integers below 2 ** 55; each of the three is exact, their sum is taken in integers
        dots = np.rint(xf @ cf.T).astype(np.int64)
        return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * dots
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer to any of its members another centroid may have come.

    Members of cluster i lie within ``radius[i]`` of ``old[i]``.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    out = np.zeros(len(old))
    for j in range(len(old)):
        way = new[j] - old[j]
        length = np.sqrt(way @ way)
        if length == 0:
            continue
        from_middle = old - (old[j] + new[j]) / 2
        along = from_middle @ way / length
        far2 = np.einsum("id,id->i", from_middle, from_middle)
        across = np.sqrt(np.maximum(far2 - along**2, 0))
        r = radius * (1 + ROOM) + ROOM
        tangent = np.sqrt(np.maximum(far2 - r**2, 0))
        # cosine of (angle of the centre - angle that the sphere takes up on either side)
        cosine = (along * tangent + across * r) / np.maximum(far2, ROOM)
        # the sphere holds the middle or reaches the line ahead of it: nothing is gained
        ahead = (r**2 >= far2) | ((along > 0) & (across <= r))
        move = length * np.where(ahead, 1.0, np.clip(cosine, 0.0, 1.0))
        move[j] = 0
        out = np.maximum(out, move)
    return out * (1 + ROOM) + ROOM


def _step(c: np.ndarray, grown: np.ndarray, loosened: np.ndarray, first: bool, last: bool):
    """One pass: new bounds and clusters for every vector, then one row per cluster of this task."""
    k, dims = c.shape
    between = np.sqrt(distances(c, c).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    half = between.min(1) / 2 * (1 - ROOM) - ROOM if k > 1 else np.full(k, np.inf)
    longs = pa.list_(pa.int64())
    kinds = {"vec_id": pa.int64(), "v": pa.list_(pa.int32()), "cluster": pa.int32(), "u": pa.float64(), "l": pa.float64(), "distance": pa.int64(), "part": pa.bool_(), "n": pa.int64(), "sums": longs, "scanned": pa.int64()}

    def rows_of(height: int, /, **columns) -> pa.RecordBatch:
        arrays = [columns[f] if isinstance(columns.get(f), pa.Array) else pa.array(columns[f], kind) if f in columns else pa.nulls(height, kind) for f, kind in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    def assign(x: np.ndarray, own: np.ndarray, u: np.ndarray, low: np.ndarray) -> int:
        """Change clusters and bounds in place; how many vectors met all centroids."""
        if first:
            open_ = np.arange(len(x))
        else:
            u += grown[own]
            low -= loosened[own]
            open_ = np.flatnonzero(u >= np.maximum(low, half[own]))
            if len(open_):
                near = ((x[open_] - c[own[open_]]) ** 2).sum(1)
                u[open_] = np.sqrt(near.astype(np.float64)) * (1 + ROOM) + ROOM
                open_ = open_[u[open_] >= np.maximum(low[open_], half[own[open_]])]
        for a in range(0, len(open_), BLOCK):
            at = open_[a : a + BLOCK]
            d = distances(x[at], c)
            best = d.argmin(1)
            rows = np.arange(len(at))
            own[at] = best
            u[at] = np.sqrt(d[rows, best].astype(np.float64)) * (1 + ROOM) + ROOM
            rest = d.astype(np.float64)
            rest[rows, best] = np.inf
            low[at] = np.sqrt(rest.min(1)) * (1 - ROOM) - ROOM
        return len(open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, radius, scanned = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k), 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, dims)
            if first:
                own, u, low = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
            else:
                own = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                u, low = (np.array(batch.column(b).to_numpy(zero_copy_only=False)) for b in ("u", "l"))
            scanned += assign(x, own, u, low)
            n += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            there, start = np.unique(own[order], return_index=True)
            sums[there] += np.add.reduceat(x[order], start, axis=0)
            np.maximum.at(radius, own, u)
            bounds = {"distance": ((x - c[own]) ** 2).sum(1)} if last else {"u": u, "l": low}
            yield rows_of(rows, vec_id=batch.column("vec_id"), v=batch.column("v"), cluster=own, part=np.zeros(rows, bool), **bounds)
        if n.any():
            yield rows_of(k, cluster=np.arange(k), u=radius, part=np.ones(k, bool), n=n, sums=list(sums), scanned=[scanned] + [0] * (k - 1))

    return run


def _summed(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Counts, sums and radius of each cluster, and the vectors that met all centroids."""
    parts = state.where("part")
    n, sums, radius, scanned = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k), 0
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("u").alias("u"), F.sum("scanned").alias("scanned")).collect():
        n[r.cluster], radius[r.cluster] = r.n, r.u
        scanned += r.scanned
    each = parts.select("cluster", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("s").alias("s"))
    for r in each.collect():
        sums[r.cluster, r.dim] = r.s
    return n, sums, radius, scanned


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 3, units: int = UNITS, dimensions: int = DIMENSIONS) -> Clustering:
    """Cluster the rows of ``vectors (vec_id, embedding)``."""
    spark = vectors.sparkSession
    usable = whole(vectors, dimensions, units)
    c = first_centroids(usable, k, seed)
    if not len(c):
        return Clustering(usable.selectExpr("vec_id", "0 as cluster", "0L as distance"), c)
    k = len(c)
    state, path, scanned = usable, None, []
    grown, loosened = np.zeros(k), np.zeros(k)
    for r in range(rounds + 1):
        before, path = path, fresh_path(spark, "centroids")
        state = written(state.mapInArrow(_step(c, grown, loosened, r == 0, r == rounds), STATE), "", path)
        if before:
            discard(spark, before)
        n, sums, radius, met = _summed(state, k, dimensions)
        scanned.append(met)
        state = state.where("not part")
        if r < rounds:
            new = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], c)
            moved = (new - c).astype(np.float64)
            grown = np.sqrt((moved**2).sum(1)) * (1 + ROOM) + ROOM
            loosened = loosening(c, new, radius)
            c = new
    return Clustering(state.select("vec_id", "cluster", "distance"), c, scanned)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def report(found: Clustering) -> DataFrame:
    """``vec_id, cluster, distance`` with the sums of distances in the cluster and in all, and the centroid's digest."""
    sums = {r.cluster: r.s for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    per = F.array(*[F.lit(sums.get(i, 0)).cast("long") for i in range(max(1, len(found.centroids)))])
    digests = F.array(*[F.lit(digest(c)) for c in found.centroids] or [F.lit("")])
    return found.assigned.select(
        "vec_id",
        "cluster",
        "distance",
        per[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        digests[F.col("cluster")].alias("centroid_sha256"),
    )
