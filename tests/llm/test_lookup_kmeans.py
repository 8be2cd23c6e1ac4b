import hashlib
import math
import random

import numpy as np
import pytest

from factloom.llm import lookup_kmeans as lk
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, dims=64):
    """The contract on Python integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [best(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, *best(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    each = {j: sum(d for _, d, c in found if c == j) for j in range(k)}
    return sorted(((i, j, d, each[j], total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vector(rng, dims=64, spread=1.0):
    return [float(np.float32(rng.gauss(0, spread))) for _ in range(dims)]


def test_random_vectors_equal_the_contract(spark):
    rng = random.Random(1)
    rows = [(n, vector(rng)) for n in range(300)] + [(n, [0.5] * 64) for n in range(300, 420)] + [(7, vector(rng)), (7, [0.5] * 64)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert got(lk.lookup_kmeans(docs)) == brute(rows)


def test_given_vectors_equal_the_contract(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in given.collect()]
    assert got(lk.lookup_kmeans(given)) == brute(rows)


def test_odd_vectors(spark):
    rng = random.Random(2)
    good = [(n, vector(rng)) for n in range(20)]
    odd = [(None, vector(rng)), (None, vector(rng)), (3, None), (4, []), (5, [1.0] * 63), (6, [1.0] * 65), (7, [None] + [1.0] * 63),
           (8, [float("nan")] + [1.0] * 63), (9, [float("inf")] * 64), (10, [-0.0] * 64), (11, [-1e-9] * 64), (12, [30000.0, -30000.0] * 32)]
    rows = good + odd
    docs = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert got(lk.lookup_kmeans(docs)) == brute(rows)


def test_few_and_no_vectors(spark):
    rng = random.Random(3)
    rows = [(n, vector(rng)) for n in range(5)] * 2
    assert got(lk.lookup_kmeans(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))) == brute(rows)
    assert lk.lookup_kmeans(cases.empty(spark, SCHEMA)).collect() == []
    assert lk.lookup_kmeans(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).collect() == []


def test_all_equal_vectors_share_one_centroid(spark):
    rows = [(n, [0.25] * 64) for n in range(100)]
    found = got(lk.lookup_kmeans(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)))
    assert found == brute(rows) and {r[1] for r in found} == {0}


def test_columns_that_clash(spark):
    rng = random.Random(5)
    rows = [(n, vector(rng)) for n in range(30)]
    docs = spark.createDataFrame([(*r, 9, "x", 3, "y", "z") for r in rows], f"{SCHEMA}, cluster string, distance int, vector string, h string")
    assert got(lk.lookup_kmeans(docs)) == brute(rows)


def test_components_out_of_range_stop_the_job(spark):
    docs = spark.createDataFrame([(1, [1e30] + [0.0] * 63, 0)], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        lk.lookup_kmeans(docs).collect()


@pytest.mark.parametrize("spread", [10, 1 << 20])
def test_tables_equal_direct_distances(spread):
    rng = np.random.default_rng(spread)
    vectors, centroids = rng.integers(-spread, spread, (200, 6)).astype(np.int32), rng.integers(-spread, spread, (5, 6))
    direct = ((vectors[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(2)
    assert (lk.distances(vectors, centroids) == direct).all()
    values, place = lk.occurring(vectors[:, 0])
    assert (values[place] == vectors[:, 0]).all() and values.tolist() == sorted(set(vectors[:, 0].tolist()))
