"""Centroid clustering of integer vectors by scalar lookup tables.

In each round and batch the squared difference is tabulated for each dimension, each integer value that occurs there and
each centroid; the distances of the batch are gathers from these tables, summed over the dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import in_batches, stored

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 27  # of a component as an integer: 64 squared differences then fit a long
NARROW = 1 << 16  # widths of a dimension's values up to which occurring ones are marked in an array, not sorted


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, vector)``: the rows of ``vectors(vec_id, embedding)`` with exactly ``dimensions`` components, none null or non-finite.

    Each component x becomes floor(scale * x). One beyond ``LARGEST`` stops the job with an error: its distances would leave a long.
    """
    usable = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    too_large = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))

    def whole_number(x):
        scaled = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(scaled) > LARGEST, too_large).otherwise(F.floor(scaled)).cast("int")

    whole = F.transform("embedding", whole_number)
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def starting_centroids(kept: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors whose ``1:<vec_id>`` has the smallest sha256, in that order; equal ids by their components, null ids last."""
    ranked = kept.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "vector")
    rows = ranked.orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and the place of each element among them."""
    low, high = int(values.min()), int(values.max())
    if high - low >= NARROW:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(high - low + 1, bool)
    seen[values - low] = True
    place = np.cumsum(seen) - 1
    return np.flatnonzero(seen) + low, place[values - low]


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each vector (row) to each centroid (column), from one table a dimension."""
    total = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1]):
        values, place = occurring(vectors[:, d])
        table = (values[:, None].astype(np.int64) - centroids[None, :, d]) ** 2
        total += table[place]
    return total


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller on a tie) and the squared distance."""
    all_of = distances(vectors, centroids)
    cluster = all_of.argmin(1)
    return cluster, all_of[np.arange(len(vectors)), cluster]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)


def moved_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid becomes floor(sum / count) of the vectors nearest to it; one without vectors stays.

    A task sends one row for each of its clusters, and the totals are as many rows as there are centroids.
    """
    k, dims = centroids.shape
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch)
                cluster, _ = nearest(vectors, shared.value)
                order = np.argsort(cluster, kind="stable")
                present, first = np.unique(cluster[order], return_index=True)
                total[present] += np.add.reduceat(vectors[order].astype(np.int64), first)
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])

    parts = kept.select("vector").mapInArrow(sums, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims))).collect()
    out = centroids.copy()
    for r in totals:
        out[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return out


def lookup_kmeans(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Cluster ``vectors(vec_id, embedding)``: ``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept row.

    Repeated rows are vectors of their own; vectors with a null, empty, short, long or non-finite embedding are left out;
    fewer kept vectors than ``k`` give as many centroids as there are vectors, and none give an empty table.
    """
    spark = vectors.sparkSession
    kept = stored(kept_vectors(vectors, dimensions, scale), "vectors")
    centroids = starting_centroids(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved_centroids(kept, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batch: pa.RecordBatch) -> dict:
        cluster, distance = nearest(_matrix(batch), shared.value)
        return {"vec_id": batch.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())}

    assigned = stored(in_batches(kept, assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # One row a centroid: k rows, whatever the tables hold.
    about = spark.createDataFrame([(c, int(s), int(sum(inertia.values())), ",".join(map(str, centroids[c].tolist()))) for c, s in sorted(inertia.items())],
                                  "cluster int, cluster_inertia long, inertia long, components string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                               F.sha2("components", 256).alias("centroid_sha256"))
