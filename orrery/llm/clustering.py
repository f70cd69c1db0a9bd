"""Centroid clustering by delta Lloyd, in exact integers.

Vectors are scaled to integers once. A stored table keeps each vector with its owner and its distance to it; the sums and counts of
all centroids stay at the driver (``k`` rows of ``dim`` integers). A round then does what has changed only:

* a vector whose owner did not move keeps its distance and is compared with the centroids that moved; one whose owner moved is compared with all;
* vectors that change owners are handed over: tasks add up signed vectors (plus for the new owner, minus for the old), at most ``2 k``
  rows a task, and their totals move the stored sums. Vectors that stay are not added up again.

No vector is shuffled. A round that moves no centroid ends the work, as later ones would change nothing.

Results in the odd cases: vectors that are null, of another length, or with a null or non-finite component are left out; components
beyond 2^27 after scaling are set to that bound, so that squared distances fit in 64 bits; with fewer than ``k`` vectors each is a
centroid; repeated rows are vectors of their own, and equal ones get equal results; a null key is named by an empty text in the
choice of first centroids, whose ties go by key, then components; ties in distance go to the smaller number; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.storage import discard, stored

DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
LARGEST = 1 << 27
EXACT = 1 << 22  # up to here sums of 64 squares are exact in doubles


def scaled(rows: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """``id``, and ``q``: floor(scale * x) of every component."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    q = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("long"))
    return rows.filter((F.size(x) == dim) & ~bad).select(F.col(key).alias("id"), q.alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the least hashes, in their order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.q for r in vectors.orderBy(h, "id", "q").limit(k).collect()], np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def nearest(q: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of the centroids ``among`` (ascending), the smaller number in ties."""
    c = centroids[among]
    if max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and q.shape[1] <= 64:
        qf, cf = q.astype(np.float64), c.astype(np.float64)
        d = ((qf * qf).sum(1)[:, None] - 2 * (qf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    else:
        d = np.stack([((q - one) ** 2).sum(1) for one in c], 1)
    at = d.argmin(1)
    return among[at], d[np.arange(len(q)), at]


def reassigned(q: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; ``owner`` is -1 where there is none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | np.isin(owner, moved)
    if lost.any():
        owner[lost], distance[lost] = nearest(q[lost], centroids, np.arange(len(centroids)))
    rest = np.flatnonzero(~lost)
    if len(rest) and len(moved):
        k, d = nearest(q[rest], centroids, moved)
        wins = (d < distance[rest]) | ((d == distance[rest]) & (k < owner[rest]))
        owner[rest[wins]], distance[rest[wins]] = k[wins], d[wins]
    return owner, distance


def _assign(vectors: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Vectors with ``was`` (the owner before), ``cluster`` and ``distance``."""
    dim = centroids.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            was, old = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cluster", "distance"))
            ids, q = b.column(b.schema.get_field_index("id")), b.column(b.schema.get_field_index("q"))
            now, d = reassigned(matrix(q, dim), was, old, centroids, moved)
            yield pa.RecordBatch.from_arrays([ids, q, pa.array(was), pa.array(now.astype(np.int32)), pa.array(d)], ["id", "q", "was", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "q", "cluster", "distance").mapInArrow(part, f"id {kind}, q array<long>, was int, cluster int, distance long")


def transfers(assigned: DataFrame, dim: int) -> dict[int, list[int]]:
    """Signed change of the sums (``dim`` integers) and the count (the last) of every centroid that vectors came to or left."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            q = np.pad(matrix(b.column(0), dim), ((0, 0), (0, 1)), constant_values=1)
            for owners, sign in ((b.column(1).to_numpy(), -1), (b.column(2).to_numpy(), 1)):
                for k in np.unique(owners[owners >= 0]).tolist():
                    held[k] = held.get(k, 0) + sign * q[owners == k].sum(0)
        for k, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.tolist()], pa.list_(pa.int64()))], ["k", "sums"])

    sums = assigned.filter("was <> cluster").select("q", "was", "cluster").mapInArrow(part, "k int, sums array<long>")
    total = sums.select("k", F.posexplode("sums").alias("pos", "v")).groupBy("k", "pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[int, list[int]] = {}
    for r in total.collect():  # at most k x (dim + 1) rows
        out.setdefault(r.k, [0] * (dim + 1))[r.pos] = int(r.v)
    return out


def delta_lloyd(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """``key, cluster, distance`` of every usable vector after ``rounds`` rounds, and the final centroids."""
    vectors = stored(scaled(rows, key, vector, dim, scale), "vectors")
    centroids = first_centroids(vectors, k, seed).reshape(-1, dim)
    if not len(centroids):
        return vectors.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    sums = [[0] * (dim + 1) for _ in centroids]
    state = vectors.withColumns({"cluster": F.lit(-1), "distance": F.lit(0).cast("long")})
    moved, last = np.arange(len(centroids)), vectors
    for turn in range(rounds + 1):
        if not len(moved):
            break
        state = stored(_assign(state, centroids, moved), "assigned")
        discard(last)
        last = state
        if turn == rounds:
            break
        for c, change in transfers(state, dim).items():
            sums[c] = [a + b for a, b in zip(sums[c], change)]
        new = np.array([[s // t[-1] for s in t[:-1]] if t[-1] else old.tolist() for t, old in zip(sums, centroids)], np.int64)
        moved = np.flatnonzero((new != centroids).any(1))
        centroids = new
    return state.select(F.col("id").alias(key), "cluster", "distance"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Assignments with the summed distances of their cluster and of all, and the digest of their centroid (a row a centroid is broadcast)."""
    digest = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    per = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = assigned.sparkSession.createDataFrame([(i, per.get(i, 0), sum(per.values()), h) for i, h in digest], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster")
