import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import sharding
from tests.llm import cases


def shards(spark, tree, n=4000):
    return {r["id"]: r["s"] for r in sharding.with_shard(spark.range(n), "id", tree, "s").collect()}


def moves(before, after):
    return Counter((before[k], after[k]) for k in before if before[k] != after[k])


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = sharding.even_tree(16)
    before, after = shards(spark, tree), shards(spark, sharding.grown(tree))
    assert moves(before, after) and all(to == 16 for _, to in moves(before, after))
    again = shards(spark, sharding.grown(sharding.grown(tree)))
    assert all(to == 17 for _, to in moves(after, again))
    assert 4000 / 17 * 0.7 < sum(1 for s in after.values() if s == 16) < 4000 / 17 * 1.3


def test_shares_follow_the_weights(spark):
    tree = [("a", "r", 0, 1.0), ("a", "r", 1, 3.0), ("b", "r", 2, 4.0), ("b", "q", 3, 0.0)]
    counts = Counter(shards(spark, tree, 8000).values())
    assert counts[3] == 0
    assert abs(counts[0] - 1000) < 150 and abs(counts[1] - 3000) < 200 and abs(counts[2] - 4000) < 200


def test_movement_is_confined_to_changed_subtrees(spark):
    tree = sharding.even_tree(16)
    heavier = [(r, k, s, 2.0 if s == 5 else w) for r, k, s, w in tree]  # shard 5: region0, rack1
    region = {s: r for r, _, s, _ in tree}
    rack = {s: (r, k) for r, k, s, _ in tree}
    for a, b in moves(shards(spark, tree), shards(spark, heavier)):
        assert region[b] == "region0"
        if region[a] == "region0":
            assert rack[b] == rack[5]
        if rack[a] == rack[5]:
            assert b == 5


def drawn(key, tree):
    """The descent in plain Python: XXH64 of the key, chained with each child's path, 53 bits of it as a draw."""
    h = xxhash.xxh64_intdigest(str(key).encode(), 42) if key is not None else 42
    h = xxhash.xxh64_intdigest((1 if key is None else 0).to_bytes(4, "little"), h)
    key_bytes = h.to_bytes(8, "little")

    def draw(path, weight):
        bits = xxhash.xxh64_intdigest(path.encode(), xxhash.xxh64_intdigest(key_bytes, 42)) >> 11
        return -math.log((bits + 0.5) / (1 << 53)) / weight

    prefix = ""
    for level in range(3):
        weights = {}
        for region, rack, shard, weight in tree:
            path = "/" + "/".join((region, rack, str(shard))[:level + 1])
            if weight and path.startswith(prefix) and (level == 0 or path.rsplit("/", 1)[0] == prefix):
                weights[path] = weights.get(path, 0) + weight
        prefix = min(weights, key=lambda p: (draw(p, weights[p]), p))
    return int(prefix.rsplit("/", 1)[1])


@pytest.mark.parametrize("tree", [sharding.even_tree(16), sharding.grown(sharding.even_tree(16)), [("a", "r", 0, 1.0), ("a", "s", 1, 3.5), ("b", "r", 2, 4.0), ("b", "q", 3, 0.0)]])
def test_draws_equal_plain_python(spark, tree):
    ids = [*range(500), None, -7, 1 << 62]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    assert {r["id"]: r["s"] for r in sharding.with_shard(rows, "id", tree, "s").collect()} == {i: drawn(i, tree) for i in ids}


def test_columns_of_the_caller_stay(spark):
    rows = spark.createDataFrame([(1, "a", "b", "c", "d")], "id long, _draw_key string, _region string, _rack string, _leaf string")
    assert tuple(sharding.with_shard(rows, "id", sharding.even_tree(4), "s").drop("s").first()) == (1, "a", "b", "c", "d")


def test_rows_slots_and_sizes(spark):
    docs = cases.documents(spark)
    tree = sharding.even_tree(4)
    got = sharding.assign_shards(docs, tree, sharding.grown(tree), slice_rows=2).collect()
    assert len(got) == docs.count()
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1 and len({r["shard"] for r in got if r["doc_id"] == 4}) == 1
    want = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted((tuple(r) for r in want.collect()), key=key)


def test_law_depends_on_id_only(spark):
    tree = sharding.even_tree(16)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, tree).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("other")), tree).collect()}
    assert all(a[k] == s for k, s in b.items())


def test_empty_clashing_and_native(spark):
    tree = sharding.even_tree(16)
    assert sharding.assign_shards(cases.empty(spark), tree).collect() == []
    got = sharding.assign_shards(cases.clashing(spark), tree)
    assert got.count() == 3 and {r["grown_shard"] for r in got.collect()} == {None}
    assert "Python" not in got._jdf.queryExecution().toString()
