"""Centroid clustering with Elkan's bounds, exact.

Vectors become integers floor(scale * x). Each round assigns every vector to its nearest centroid
(squared Euclidean distance, ties to the smaller number) and then replaces each centroid that has
vectors by their componentwise floor(sum / count); at last vectors are assigned once more.

A vector keeps an upper bound of the distance to its own centroid and a lower bound for each of
the k. When centroids have moved, bounds widen by how far they moved. A centroid is skipped where
the upper bound is below its lower bound, or below half its distance to the own centroid: strictly
below, so that ties are always computed. Bounds are kept as 32-bit floats, rounded outwards, and
only decide what is skipped: the distances that are compared are exact integers. So the result
is that of comparing all of them.

The vectors with their bounds are a table that each round writes anew (the one before is
dropped), so a lost executor costs one round's tasks. Tasks add up their vectors by cluster while
they assign them and write the sums beside the rows: a few rows a task, summed by Spark. The
driver gets centroids alone, which have a fixed size.

Rows with a vector that is null, has another length than `size`, or holds null or non-finite
components take no part. Centroids start as the k rows with the least hash of `seed:id`; a null id
comes after all others, equal ids are ordered by their vectors. Fewer than k rows make as many clusters.
Repeated rows count as often as they are there. Empty tables give none; further columns are left
out, whatever their names. Components of 2^27 and more in size raise an error: squared
distances of them may not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, drop_path, quoted, scratch, stored

by_value(__name__)

#: Components that squared distances of 64 such vectors hold in a long.
LARGEST = 2**27


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector is there, has `size` components (any number if None) and none is null or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    right = F.size(vector) == size if size is not None else F.lit(True)
    return F.coalesce(vector.isNotNull() & right & ~odd, F.lit(False))


def squares(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows (n, d) and centroids (k, d), as int64 (n, k)."""
    most = max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0))
    exact = np.float64 if 4 * rows.shape[1] * int(most) ** 2 < 2**53 else np.int64  # doubles hold the products' sums
    x, c = rows.astype(exact), centroids.astype(exact)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def own_squares(rows: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    return ((rows - theirs) ** 2).sum(axis=1)


def outward(values: np.ndarray, up: bool) -> np.ndarray:
    """Values as 32-bit floats, a step further up or down than rounding may have gone; never below 0."""
    return np.maximum(np.nextafter(np.asarray(values).astype(np.float32), np.float32(np.inf if up else -np.inf)), np.float32(0))


def assign(rows, own, upper, lower, centroids, moved):
    """One round's assignment: (own, upper, lower, distances computed).

    own is None at first, when all distances are computed. moved: how far each centroid has moved
    since the bounds were made.
    """
    n, k = len(rows), len(centroids)
    if own is None:
        d = squares(rows, centroids)
        best, root = d.argmin(axis=1), np.sqrt(d.astype(np.float64))  # argmin takes the first of equals
        return best.astype(np.int32), outward(root[np.arange(n), best], True), outward(root, False), d.size
    moved = np.asarray(moved) * (1 + 1e-12)
    upper = outward(upper.astype(np.float64) + moved[own], True)
    lower = outward(lower.astype(np.float64) - moved[None, :], False)
    half = outward(np.sqrt(squares(centroids, centroids).astype(np.float64)) / 2, False)

    def open_to(at):
        """Centroids that bounds don't rule out for the rows `at`."""
        able = (upper[at, None] >= lower[at]) & (upper[at, None] >= half[own[at]])
        able[np.arange(len(at)), own[at]] = False
        return able

    own = own.copy()
    at = np.flatnonzero(open_to(np.arange(n)).any(axis=1))
    mine = own_squares(rows[at], centroids[own[at]])
    root = np.sqrt(mine.astype(np.float64))
    upper[at], lower[at, own[at]] = outward(root, True), outward(root, False)
    able = open_to(at)
    made, start = len(at), own[at].copy()
    best, best_at, reach = mine.copy(), start.copy(), upper[at]
    for c in range(k):
        ask = np.flatnonzero(able[:, c] & (reach >= lower[at, c]) & (reach >= half[best_at, c]))
        if not len(ask):
            continue
        d = own_squares(rows[at[ask]], centroids[c][None, :])
        made += len(ask)
        root = np.sqrt(d.astype(np.float64))
        lower[at[ask], c] = outward(root, False)
        closer = (d < best[ask]) | ((d == best[ask]) & (c < best_at[ask]))
        best[ask[closer]], best_at[ask[closer]], reach[ask[closer]] = d[closer], c, outward(root[closer], True)
    own[at], upper[at] = best_at, reach
    return own, upper, lower, made


def _matrix(column: pa.Array, size: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, size)


def _round(state: DataFrame, id_type: str, size: int, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The state after one assignment, with a row for each cluster a task has seen: its number of vectors and their sums."""
    k = len(centroids)
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), kind))
    schema = f"id {id_type}, x array<int>, own int, upper float, lower array<float>, cluster int, n bigint, sums array<bigint>, made bigint"
    names = ["id", "x", "own", "upper", "lower", "cluster", "n", "sums", "made"]

    def run(batches):
        counts, sums, made, kind = np.zeros(k, np.int64), np.zeros((k, size), np.int64), 0, None
        for b in batches:
            x = _matrix(b.column("x"), size, np.int64)
            kind = b.schema.field("id").type
            if not len(x):
                continue
            if np.abs(x).max() >= LARGEST:
                raise OverflowError("a component's size is 2^27 or more")
            before = (None, None, None) if moved is None else (b.column("own").to_numpy(), b.column("upper").to_numpy(), _matrix(b.column("lower"), k, np.float32))
            own, upper, lower, some = assign(x, *before, centroids, moved)
            made += some
            for c in np.unique(own):
                counts[c] += (own == c).sum()
                sums[c] += x[own == c].sum(axis=0)
            none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(own), pa.array(upper), lists(lower, pa.float32()), *none], names=names)
        if some := np.flatnonzero(counts).tolist():
            none = [pa.nulls(len(some), t) for t in (kind, pa.list_(pa.int32()), pa.int32(), pa.float32(), pa.list_(pa.float32()))]
            shared = pa.array([made, *[0] * (len(some) - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array(counts[some]), lists(sums[some], pa.int64()), shared], names=names)

    return state.mapInArrow(run, schema)


def clusters(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: float = 1024.0,
    seed: str = "3", watch=None
) -> DataFrame:
    """A row for each vector that takes part: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    watch(made): called with the number of distances that each assignment has computed.
    """
    path, id_type = scratch(df.sparkSession), dict(df.dtypes)[id_col]
    whole = F.transform(quoted(vector_col), lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(scale) * x.cast("double")))).cast("int"))
    state = stored(df.filter(usable(quoted(vector_col), size)).select(quoted(id_col).alias("id"), whole.alias("x")), f"{path}/0")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.select("id", "x", named.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    result = f"id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return df.sparkSession.createDataFrame([], result)
    centroids, moved = np.array([r.x for r in first], dtype=np.int64), None
    for n in range(1, rounds + 2):
        state = stored(_round(state, id_type, size, centroids, moved), f"{path}/{n}")
        drop_path(df.sparkSession, f"{path}/{n - 1}")
        told = state.filter("n is not null").select("cluster", "n", "made", F.posexplode("sums").alias("at", "s"))
        sums = told.groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("made").alias("made")).collect()  # k times size
        state = state.filter("n is null").select("id", "x", "own", "upper", "lower")
        if watch:
            watch(sum(r.made for r in sums if r["at"] == 0))
        if n == rounds + 1:
            break
        new = centroids.copy()
        for r in sums:
            new[r.cluster, r["at"]] = r.s // r.n
        moved = np.sqrt(own_squares(new, centroids).astype(np.float64))
        if not moved.any() and not watch:  # further rounds would change nothing
            break
        centroids = new
    return _measured(state, id_type, size, centroids, result)


def _measured(state: DataFrame, id_type: str, size: int, centroids: np.ndarray, result: str) -> DataFrame:
    """The result's rows: distances again, from the integers; inertias are their sums by cluster."""

    def run(batches):
        for b in batches:
            own = b.column("own").to_numpy()
            d = own_squares(_matrix(b.column("x"), size, np.int64), centroids[own])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.int32()), pa.array(d, pa.int64())], names=["id", "cluster", "distance"])

    found = state.select("id", "x", "own").mapInArrow(run, f"id {id_type}, cluster int, distance bigint")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    held = state.sparkSession.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(held), "cluster").select(*[f.split()[0] for f in result.split(", ")])

