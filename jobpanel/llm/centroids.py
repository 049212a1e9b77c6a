"""Clusters of integer vectors around integer centroids, by scalar lookup tables.

In every round the squared difference is tabulated for each dimension, each integer
value that occurs there and each centroid; the distance of a vector to a centroid is
then a sum of table entries. Tables belong to a block of rows, so their size is bounded
by the block however many different values the whole table has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import fresh
from ..session import checkpoint


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """`_id` and `_v`, floor(scale * x) of every component, for rows with `dims` finite components.

    Components must stay below sqrt(2^61 / dims) after scaling, 1.9e8 for 64 dimensions,
    so that every squared distance is a 64-bit number; larger ones raise.
    """
    vector, largest = F.col("_x"), math.isqrt((1 << 61) // dims)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    inside = F.forall(whole, lambda x: F.abs(x) < largest)
    return df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("_x")).filter(
        (F.size(vector) == dims) & finite).select(
        "_id", F.when(inside, whole).otherwise(
            F.raise_error(F.lit("a component is too large for exact distances"))).cast("array<int>").alias("_v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the position of each element among them."""
    low, high = int(values.min()), int(values.max())
    if high - low < 4 * len(values):  # a dense range is looked up by the value itself
        present = np.zeros(high - low + 1, dtype=bool)
        present[values - low] = True
        return np.flatnonzero(present) + low, (np.cumsum(present) - 1)[values - low]
    return np.unique(values, return_inverse=True)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every vector to every centroid."""
    total = np.zeros((len(vectors), len(centroids)), dtype=np.int64)
    for d in range(vectors.shape[1]):
        values, place = occurring(vectors[:, d])
        table = values[:, None] - centroids[None, :, d]
        total += (table * table)[place]
    return total


def _sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Exact sum per cluster and dimension; dimension -1 holds the cluster's size."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if len(batch):
                vectors = matrix(batch.column(0), dims)
                nearest = distances(vectors, centroids).argmin(axis=1)  # the first of equals
                np.add.at(total, nearest, vectors)
                size += np.bincount(nearest, minlength=k)
        own = np.flatnonzero(size)
        yield pa.RecordBatch.from_pydict({
            "cluster": np.repeat(own, dims + 1).astype(np.int32),
            "dim": np.tile(np.arange(-1, dims), len(own)).astype(np.int32),
            "total": np.column_stack([size, total])[own].ravel()})

    parts = rows.select("_v").mapInArrow(run, "cluster int, dim int, total bigint")
    return parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; one without vectors stays."""
    sums = {(r["cluster"], r["dim"]): int(r["total"]) for r in _sums(rows, centroids).collect()}  # k * (dims + 1) numbers
    out = centroids.copy()
    for c, row in enumerate(out):
        n = sums.get((c, -1), 0)
        if n:
            row[:] = [sums[c, d] // n for d in range(len(row))]
    return out


def _nearest(centroids: np.ndarray) -> object:
    @F.arrow_udf("struct<cluster:int,distance:bigint>")
    def nearest(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.struct([("cluster", pa.int32()), ("distance", pa.int64())]))
        all_ = distances(matrix(column, centroids.shape[1]), centroids)
        best = all_.argmin(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(best.astype(np.int32)), pa.array(all_[np.arange(len(best)), best])], ["cluster", "distance"])

    return nearest


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3,
    dims: int = 64, scale: int = 64, seed: int = 1,
) -> DataFrame:
    """One row per kept vector: id, `cluster`, `distance`, `cluster_inertia`, `inertia`, `centroid`.

    Vectors with exactly `dims` finite components count, as floor(scale * x). Centroids
    start as the `k` vectors with the smallest SHA-256 of `seed:id` (of equal ids, a null
    one counting as empty, the smaller vector first; fewer vectors give fewer centroids).
    Each round assigns all vectors to the nearest centroid, ties to the smaller number,
    and moves the centroids; at the end vectors are assigned once more. Repeated rows
    each count, an empty table gives an empty one, other columns are not read. An added
    name that the id has gets an underscore in front. Components too
    large for 64-bit distances raise; a sum of distances beyond 64 bits is null.
    """
    spark = df.sparkSession
    names = fresh([id_col], "cluster", "distance", "cluster_inertia", "inertia", "centroid")
    rows = checkpoint(integer_vectors(df, id_col, vector_col, dims, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = rows.select("_v", key.alias("_key")).orderBy("_key", "_v").limit(k).collect()
    centroids = np.array([r["_v"] for r in first], dtype=np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        centroids = _moved(rows, centroids)
    near = checkpoint(rows.select("_id", _nearest(centroids)("_v").alias("_at")).select("_id", "_at.*"))
    sums = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in sums}  # one number per centroid
    whole = sum(inertia.values())

    def bounded(x: int) -> int | None:
        return x if x < 1 << 63 else None

    table = spark.createDataFrame(
        [(c, bounded(inertia[c]), bounded(whole), [int(x) for x in centroids[c]]) for c in inertia],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    own = near.join(F.broadcast(table), "cluster")  # at most k rows
    return own.select(
        F.col("_id").alias(id_col),
        *[F.col(c).alias(n) for c, n in zip(("cluster", "distance", "cluster_inertia", "inertia", "centroid"), names)])

