"""Exact cosine search over an index of clusters: what the triangle inequality rules out is not read.

Vectors of length 1 lie at angles to each other, and angles obey the triangle inequality. A cluster whose centre is at angle t to a
query, and whose members are at most at angle r to the centre, has no member nearer to the query than t - r.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.common import top_per_group
from factloom.operators.matching import _query_blocks
from factloom.session import scratch_path

MAX_CENTRES = 1_024  # centres are a parameter of every task
MEMBERS = 2_000  # vectors of a cluster, about, below that number of centres
SLACK = 1e-9  # of cosines, for rounding


@dataclass(frozen=True)
class VectorIndex:
    """Stored unit vectors by cluster, and of each cluster the centre, the widest angle to it and the number of members."""

    rows: DataFrame
    block_id: str
    centres: np.ndarray
    widest: np.ndarray
    members: np.ndarray


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the vectors at length 1, and which of the rows are left (null and zero vectors are not)."""
    live = np.flatnonzero(vectors.notna())
    if not live.size:
        return np.zeros((0, 1)), live
    m = np.stack(vectors.iloc[live].to_numpy()).astype(np.float64)
    norms = np.linalg.norm(m, axis=1)
    return m[norms > 0] / norms[norms > 0, None], live[norms > 0]


def _centres(blocks: DataFrame, block_id: str, vector: str, n: int) -> np.ndarray:
    """Centres: the vectors with the smallest hashes of their ids, moved once to the mean direction of what is nearest to them."""
    drawn = blocks.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(block_id), block_id).limit(n).select(vector).toPandas()
    start, _ = _unit(drawn[vector]) if len(drawn) else (np.zeros((0, 1)), None)
    if not len(start):
        return start
    shared = blocks.sparkSession.sparkContext.broadcast(start)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(shared.value)
        for batch in batches:
            m, _ = _unit(batch[vector])
            if len(m):
                np.add.at(total, (m @ shared.value.T).argmax(1), m)
        some = np.flatnonzero(np.abs(total).sum(1))
        if some.size:  # a task without vectors (a split of a file without rows) gives none; an empty column has no array type
            yield pd.DataFrame({"cluster": some, "s": list(total[some])})

    parts = blocks.select(vector).mapInPandas(sums, "cluster long, s array<double>")
    moved = start.copy()
    for r in parts.select("cluster", F.posexplode("s")).groupBy("cluster", "pos").agg(F.sum("col").alias("s")).groupBy("cluster").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("s")).collect():
        moved[r["cluster"]] = r["s"]
    norms = np.linalg.norm(moved, axis=1, keepdims=True)
    return np.where(norms > 0, moved / np.maximum(norms, 1e-300), start)


def build_index(blocks: DataFrame, block_id: str = "block_id", vector: str = "embedding", members: int = MEMBERS) -> VectorIndex:
    """An index of ``blocks(block_id, vector)``, stored by cluster in the shared folder. Null and zero vectors are in no result and are left out."""
    spark = blocks.sparkSession
    n = min(MAX_CENTRES, 1 + blocks.count() // members)
    centres = _centres(blocks, block_id, vector, n)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m, live = _unit(batch[vector])
            if len(m):
                cosines = m @ shared.value.T
                nearest = cosines.argmax(1)
                yield pd.DataFrame({block_id: batch[block_id].iloc[live].to_numpy(), "unit": list(m), "cluster": nearest, "cosine": cosines[np.arange(len(m)), nearest]})

    kind = dict(blocks.dtypes)[block_id]
    placed = blocks.select(block_id, vector).mapInPandas(assign, f"{block_id} {kind}, unit array<double>, cluster int, cosine double")
    path = scratch_path(spark, "vector-index")
    placed.write.partitionBy("cluster").parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    told = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n")).collect()}
    least = np.array([told[c]["least"] if c in told else 1.0 for c in range(len(centres))])
    return VectorIndex(rows, block_id, centres, np.arccos(np.clip(least - SLACK, -1, 1)), np.array([told[c]["n"] if c in told else 0 for c in range(len(centres))]))


def _bounds(index: VectorIndex, matrix: np.ndarray) -> np.ndarray:
    """For each query and cluster the highest cosine that a member can have."""
    if not len(index.centres):
        return np.zeros((len(matrix), 0))
    angle = np.arccos(np.clip(matrix @ index.centres.T, -1, 1))
    return np.where(index.members > 0, np.cos(np.maximum(0, angle - index.widest)) + SLACK, -np.inf)


def _scored(index: VectorIndex, ids: list, matrix: np.ndarray, wanted: np.ndarray, id_type: str, k: int, floor: np.ndarray) -> DataFrame:
    """Best ``k`` of each batch for each query, in the clusters a query wants."""
    clusters = np.flatnonzero(wanted.any(0)).tolist()
    shared = index.rows.sparkSession.sparkContext.broadcast((ids, matrix, {c: np.flatnonzero(wanted[:, c]) for c in clusters}, floor))
    name = index.block_id

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, queries, of_cluster, least = shared.value
        for batch in batches:
            for cluster, part in batch.groupby("cluster"):
                asked = of_cluster[cluster]
                cosines = np.stack(part["unit"].to_numpy()) @ queries[asked].T
                for j, q in enumerate(asked):
                    keep = np.flatnonzero(cosines[:, j] >= least[q])
                    if len(keep):
                        found = pd.DataFrame({"query_id": known[q], name: part[name].to_numpy()[keep], "score": cosines[keep, j]})
                        yield found.sort_values(["score", name], ascending=[False, True]).head(k)

    kind = dict(index.rows.dtypes)[name]
    rows = index.rows.where(F.col("cluster").isin(clusters)) if clusters else index.rows.where(F.lit(False))
    found = rows.select(name, "unit", "cluster").mapInPandas(score, f"query_id {id_type}, {name} {kind}, score double")
    return top_per_group(found, ["query_id"], [F.desc("score"), F.asc(name)], k, rank="rank")


def _wanted(index: VectorIndex, matrix: np.ndarray, id_type: str, k: int, min_score: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Clusters that each query has to read, and the least score that counts for it.

    Without a least score the nearest clusters that hold k members are read first: the k-th best score found there is one.
    """
    bounds = _bounds(index, matrix)
    floor = np.full(len(matrix), -np.inf if min_score is None else min_score)
    if min_score is None and len(index.centres):
        order = np.argsort(-bounds, axis=1)
        before = np.cumsum(index.members[order], axis=1) - index.members[order]
        first = np.zeros_like(bounds, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        numbers = [int(i) for i in range(len(matrix))]
        best = _scored(index, numbers, matrix, first & (index.members > 0), "int", k, floor).where(F.col("rank") == k).collect()
        for r in best:
            floor[r["query_id"]] = r["score"] - SLACK
    return (bounds >= floor[:, None] - SLACK) & (index.members > 0), floor


def search(index: VectorIndex, queries: DataFrame, k: int, min_score: float | None = None, query_id: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """``(query_id, <block_id>, score, rank)``: the exact best ``k`` blocks of each query; ties by block id. Queries are a table of any length."""
    id_type = dict(queries.dtypes)[query_id]
    parts = []
    for ids, matrix in _query_blocks(queries, query_id, query_vector):
        if not len(ids):
            matrix = np.zeros((0, index.centres.shape[1]))
        wanted, floor = _wanted(index, matrix, id_type, k, min_score)
        parts.append(_scored(index, ids, matrix, wanted, id_type, k, floor))
    return functools.reduce(DataFrame.unionByName, parts)


def share_read(index: VectorIndex, queries: DataFrame, k: int, min_score: float | None = None, query_id: str = "query_id", query_vector: str = "vector") -> float:
    """Part of all pairs of query and vector that ``search`` compares in its last step."""
    compared = pairs = 0
    for ids, matrix in _query_blocks(queries, query_id, query_vector):
        if len(ids):
            wanted, _ = _wanted(index, matrix, dict(queries.dtypes)[query_id], k, min_score)
            compared += int((wanted * index.members).sum())
            pairs += len(ids) * int(index.members.sum())
    return compared / pairs if pairs else 0.0
