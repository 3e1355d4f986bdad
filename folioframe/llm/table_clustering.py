"""Centroid clustering of integer vectors with scalar lookup tables.

Vectors are turned into integers once. In each round a task tabulates, for every dimension, the squared difference of
each integer that occurs there and each centroid; the distance of a vector is the sum of one table row per dimension.
Only counts and sums of each cluster leave a task, so that a cluster may hold any share of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.session import discard, materialize

# Integers below this keep every distance of 64 dimensions inside a long.
LARGEST = 1 << 27
# Vectors whose tables are made together; a table has no more rows than these.
ROWS = 8192


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors with ``dims`` components, none null or non-finite; x is floor(scale * component)."""
    finite = F.forall(column, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.filter((F.size(column) == dims) & finite).select(
        "vec_id", F.transform(column, lambda v: F.floor(v.cast("double") * scale)).alias("x")
    )


def first_centroids(integers: DataFrame, k: int = 16, seed: int = 1) -> list[list[int]]:
    """The vectors with the ``k`` smallest hashes of their ids, in that order.

    Rows with the same id follow each other by their components; rows without id come last. Fewer vectors than ``k``
    give fewer centroids. The driver gets ``k`` rows.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in integers.select("x", draw.alias("draw")).orderBy(F.asc_nulls_last("draw"), "x").limit(k).collect()]


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """One row per dimension."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST} or more have no distance that fits a long")
    return np.ascontiguousarray(x.T)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every vector (a column of ``x``) to every centroid, by gathers from one table a dimension."""
    total = np.zeros((x.shape[1], len(centroids)), np.int64)
    for values, of_dimension in zip(x, centroids.T):
        occurring, place = np.unique(values, return_inverse=True)
        table = (occurring[:, None] - of_dimension[None, :]) ** 2
        total += table[place]
    return total


def _assignments(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            part = batch.slice(start, ROWS)
            x = _matrix(part.column(1), centroids.shape[1])
            far = distances(x, centroids)
            nearest = far.argmin(axis=1)  # the first of equal distances
            yield part.column(0), x, nearest, far[np.arange(len(nearest)), nearest]


def moved(integers: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the exact floor of each component's mean; an empty cluster keeps its own.

    A task emits one row of sums for each cluster it has met; the driver gets one row for each cluster.
    """
    now = np.array(centroids, np.int64)
    dims = now.shape[1]
    sums = [f"s{d}" for d in range(dims)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
        for _, x, nearest, _ in _assignments(batches, now):
            order = np.argsort(nearest, kind="stable")
            found, start = np.unique(nearest[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(x[:, order], start, axis=1).T
                count += np.bincount(nearest, minlength=len(now))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(count[met]), *(pa.array(total[met, d]) for d in range(dims))], ["cluster", "n", *sums]
        )

    fields = ", ".join(f"{c} long" for c in ["n", *sums])
    rows = integers.mapInArrow(partial, f"cluster int, {fields}").groupBy("cluster")
    following = [list(c) for c in centroids]
    for r in rows.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *sums]]).collect():
        following[r["cluster"]] = [int(r[s]) // int(r["n"]) for s in sums]
    return following


def assigned(integers: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector: its nearest centroid, the smaller number of equal ones."""
    now = np.array(centroids, np.int64)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, nearest, distance in _assignments(batches, now):
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    id_type = integers.schema["vec_id"].dataType.simpleString()
    return integers.mapInArrow(label, f"vec_id {id_type}, cluster int, distance long")


@dataclass
class Clustering:
    """``vectors``: (vec_id, cluster, distance); ``clusters``: (cluster, centroid, n, cluster_inertia, inertia), at most
    k rows, with the distances summed over the cluster and over all vectors."""

    vectors: DataFrame
    clusters: DataFrame


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> Clustering:
    """Cluster the vectors of ``dims`` finite components around ``k`` centroids.

    Every kept row is assigned, rows with the same id or without one as well. Vectors of another length or with a null
    or non-finite component are not kept; a component of 2**27 or more after scaling is an error, because its distance
    has no place in a long. Without any vector both tables are empty. Extra columns are not read.
    """
    spark = vectors.sparkSession
    integers = materialize(integer_vectors(vectors, dims, scale))
    centroids = first_centroids(integers, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(integers, centroids)
    labelled = materialize(assigned(integers, centroids or [[0] * dims]))
    discard(integers)
    sums = labelled.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")).collect()
    size, inertia = {r["cluster"]: r["n"] for r in sums}, {r["cluster"]: r["inertia"] for r in sums}
    rows = [(c, x, size.get(c, 0), inertia.get(c, 0), sum(inertia.values())) for c, x in enumerate(centroids)]
    fields = "cluster int, centroid array<long>, n long, cluster_inertia long, inertia long"
    return Clustering(labelled, spark.createDataFrame(rows, fields))
