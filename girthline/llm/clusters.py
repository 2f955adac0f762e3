"""k-means in integers, its assignments filtered by leading rotated coordinates and residual norms.

A component x becomes the integer floor(1024 x). A principal-component rotation is fitted once on the sums and products of all
vectors; each vector keeps its first ``lead`` rotated coordinates and the norm of the rest. As a rotation keeps lengths,
|x - c|^2 is at least |x' - c'|^2 + (r - s)^2, with x', c' the leading coordinates and r, s the residual norms. Each vector takes the exact integer
distance to the centroid with the least bound; only centroids whose bound, less a margin above any rounding error, doesn't
exceed it are verified, in 64-bit integers too. So assignments, sums, centroids and distances are exact, ties included.

A round is one pass over the stored vectors: each task adds up its vectors for each centroid, and ``k * dims`` sums come to the driver, as do
the ``dims * dims`` products of the rotation and the first ``k`` vectors; no other rows do. Tasks work on one Arrow batch at a time.

Vectors that are null, of another length, or with a null or non-finite component are left out. Integers must lie within 2^27
(x within 131,072), so that distances fit a long; beyond that the job fails with a message. With fewer than ``k`` vectors each
starts a centroid; without any the result is empty. Rows with equal ids are vectors of their own; those without an id never come
before others as first centroids. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girthline.session import cut

DIMS, CLUSTERS, ROUNDS, SEED, LEAD = 64, 8, 10, 3, 16
LIMIT = 1 << 27


def whole_vectors(table: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """``vec_id`` and the integer components ``x`` of the vectors that count."""
    kept = table.select(F.col(vec_id).alias("vec_id"), F.transform(vector, lambda v: v.cast("double")).alias("v")).where(F.size("v") == dims)
    kept = kept.where(F.forall("v", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))))
    far = F.raise_error(F.lit(f"a component beyond {LIMIT >> 10}: its distances don't fit a long")).cast("bigint")
    return kept.select("vec_id", F.transform("v", lambda v: F.when(F.abs(v) > LIMIT >> 10, far).otherwise(F.floor(v * 1024))).alias("x"))


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), kind).reshape(-1, dims)


def _rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthogonal matrix of the principal directions, the largest first; its precision has no effect on the result."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = np.column_stack([_matrix(batch.column("x"), dims, np.float64), np.ones(batch.num_rows)])
            total += x.T @ x
        at = np.arange(total.size)
        yield pa.record_batch({"i": pa.array(at, pa.int32()), "s": pa.array(total.ravel(), pa.float64())})

    sums = vectors.select("x").mapInArrow(products, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    total = np.array([r.s for r in sums]).reshape(dims + 1, dims + 1) if sums else np.zeros((dims + 1, dims + 1))
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    return np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1].copy()


def _rotated(x: np.ndarray, turn: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the others."""
    y = x.astype(np.float64) @ turn
    return y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(1))


def _stored(vectors: DataFrame, turn: np.ndarray, dims: int, lead: int) -> DataFrame:
    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims, np.int64)
            y, rest = _rotated(x, turn, lead)
            small = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(x), [None, pa.py_buffer(x.astype("<i4").tobytes())])
            front = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * lead), len(x), [None, pa.py_buffer(y.astype("<f8").tobytes())])
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "x": small.cast(pa.binary()), "front": front.cast(pa.binary()), "rest": pa.array(rest)})

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return cut(vectors.mapInArrow(rotate, f"vec_id {id_type}, x binary, front binary, rest double"))


def _bytes(column: pa.Array, kind: str, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def nearest(x: np.ndarray, front: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid (the smaller number on ties), and how many exact distances it took."""
    lead = front.shape[1]
    c_front, c_rest = _rotated(centroids, turn, lead)
    low = (rest[:, None] - c_rest) ** 2
    for j in range(lead):
        low += (front[:, j, None] - c_front[:, j]) ** 2
    # Rounding: every term comes from sums of at most ``dims`` products of doubles, so it is off by far less than this share.
    lengths = (front ** 2).sum(1) + rest ** 2
    low -= 1e-9 * (lengths[:, None] + (c_front ** 2).sum(1) + c_rest ** 2) + 1e-6
    rows = np.arange(len(x))
    exact = lambda at, k: ((x[at] - centroids[k]) ** 2).sum(1)
    best = low.argmin(1) if len(x) else np.zeros(0, np.int64)
    distance = exact(rows, best)
    first, tested = best.copy(), len(x)
    for k in range(len(centroids)):
        at = np.flatnonzero((low[:, k] <= distance) & (first != k))
        found = exact(at, k)
        better = (found < distance[at]) | (found == distance[at]) & (k < best[at])
        distance[at[better]], best[at[better]] = found[better], k
        tested += len(at)
    return best, distance, tested


def _sums(stored: DataFrame, centroids: np.ndarray, turn: np.ndarray, dims: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact componentwise sums and counts of the vectors of each centroid."""
    k = len(centroids)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = _bytes(batch.column("x"), "<i4", dims).astype(np.int64)
            best, _, _ = nearest(x, _bytes(batch.column("front"), "<f8", lead), np.asarray(batch.column("rest")), centroids, turn)
            for j in range(k):
                mine = best == j
                total[j, :dims] += x[mine].sum(0)
                total[j, dims] += mine.sum()
        yield pa.record_batch({"i": pa.array(np.arange(total.size), pa.int32()), "s": pa.array(total.ravel())})

    rows = stored.select("x", "front", "rest").mapInArrow(added, "i int, s bigint").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    total = np.array([r.s for r in rows], np.int64).reshape(k, dims + 1)
    return total[:, :dims], total[:, dims]


def _first(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r.x for r in rows], np.int64)


def clustered(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS,
    seed: int = SEED, lead: int = LEAD,
) -> tuple[DataFrame, np.ndarray]:
    """Rows ``vec_id, cluster, distance`` and the centroids."""
    vectors = whole_vectors(table, vec_id, vector, dims)
    centroids = _first(vectors, k, seed).reshape(-1, dims)
    turn = _rotation(vectors, dims)
    stored = _stored(vectors, turn, dims, lead)
    for _ in range(rounds if len(centroids) else 0):
        sums, counts = _sums(stored, centroids, turn, dims, lead)
        full = counts > 0
        centroids = np.where(full[:, None], sums // np.maximum(counts, 1)[:, None], centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bytes(batch.column("x"), "<i4", dims).astype(np.int64)
            best, distance, _ = nearest(x, _bytes(batch.column("front"), "<f8", lead), np.asarray(batch.column("rest")), centroids, turn)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": pa.array(best, pa.int32()), "distance": pa.array(distance, pa.int64())})

    id_type = stored.schema["vec_id"].dataType.simpleString()
    return stored.mapInArrow(assigned, f"vec_id {id_type}, cluster int, distance bigint"), centroids


def centroid_sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the inertia of the row's cluster, of all clusters, and the digest of the final centroid. At most ``k`` rows are collected."""
    rows = cut(rows)
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, sums[c], sum(sums.values()), centroid_sha256(centroids[c])) for c in sorted(sums)]
    small = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
