import random
import re

import numpy as np
import pytest
import xxhash

from factloom.llm import simhash
from tests.llm import cases


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, budget=3):
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(prints))]


def check(rows, docs):
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["fingerprint"], -1 if r["component_id"] is None else r["component_id"])
                  for r in simhash.simhash_components(docs).collect()))
    prints = [brute_fingerprint(t) for _, t in rows]
    want = sorted((d is not None, d or 0, f"{p:016x}", -1 if c is None else c)
                  for (d, _), p, c in zip(rows, prints, brute_components([d for d, _ in rows], prints)))
    assert got == want


def test_odd_documents(spark):
    docs = cases.documents(spark)
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], docs)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], docs)


def test_shingles_repeat_and_spark_hash_agrees(spark):
    text = "A b c  d\x0be A b c d e É é"
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert simhash.fingerprint(b"x y z") == spark.sql("select xxhash64('x y z') h").first()["h"] % (1 << 64)


def linked(values, budget, depth):
    groups = {}
    for v in values:
        groups.setdefault(int(v) >> (64 - depth), []).append(v)
    edges = []
    keys = sorted(groups)
    for i, a in enumerate(keys):
        edges.append(simhash.trie_links(np.array(sorted(groups[a]), np.uint64), None, depth, budget))
        for b in keys[i + 1:]:
            edges.append(simhash.trie_links(np.array(sorted(groups[a]), np.uint64), np.array(sorted(groups[b]), np.uint64), depth, budget))
    label = {int(v): int(v) for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for u, v in edges:
        for x, y in zip(u.tolist(), v.tolist()):
            a, b = sorted((find(x), find(y)))
            label[b] = a
    return {int(v): find(int(v)) for v in values}


@pytest.mark.parametrize("seed,budget,frontier", [(1, 3, 1 << 20), (2, 3, 64), (3, 0, 64), (4, 5, 1000)])
def test_trie_join_equals_all_pairs(seed, budget, frontier, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    values = set(centres)
    for c in centres:
        for _ in range(rng.randrange(12)):
            v = c
            for _ in range(rng.randrange(6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    got = linked(values, budget, 3)
    components = brute_components(values, values, budget)
    assert {v: got[v] for v in values} == dict(zip(values, components))


@pytest.mark.parametrize("seed,budget,subtrie", [(1, 3, 2), (4, 2, 40)])
def test_crowded_pairs_are_taken_further_down(spark, seed, budget, subtrie):
    """Most fingerprints lie under one long prefix; links equal those of all pairs, and no group holds more than it may."""
    rng = random.Random(seed)
    hot = 0xABCDEF0123456789
    values = {hot ^ sum(1 << rng.randrange(24) for _ in range(rng.randrange(5))) & ((1 << 64) - 1) for _ in range(150)}
    values |= {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1, (1 << 63) - 1, 3}
    values = sorted(v & ((1 << 64) - 1) for v in values)
    signed = {int(np.uint64(v).view(np.int64)): v for v in values}
    distinct = spark.createDataFrame([(s,) for s in signed], "fp long")
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for e in simhash.trie_self_join(distinct, budget, subtrie).collect():
        a, b = sorted((find(signed[e["u"]]), find(signed[e["v"]])))
        label[b] = a
    assert [find(v) for v in values] == brute_components(values, values, budget)
    for depth, pairs in simhash._node_pairs(distinct, budget, subtrie, 4).items():
        for r in pairs.collect():
            mine = [v for v in values if v >> (64 - depth) in (r["a"] & ((1 << 64) - 1), r["b"] & ((1 << 64) - 1))]
            assert len(mine) <= 2 * subtrie or depth == 64
            assert (r["a"] ^ r["b"]).bit_count() <= budget if r["a"] >= 0 <= r["b"] else True


def test_dense_ball_is_one_component(spark):
    base = 0x0123456789ABCDEF
    values = [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    distinct = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    edges = simhash.trie_self_join(distinct).collect()
    assert len(edges) < 30 * len(values)  # sets, not pairs
    from factloom.llm.components import components
    frame = spark.createDataFrame(edges, "u long, v long")
    assert components(frame).select("label").distinct().count() == 1


def test_near_dedup_keeps_one_of_each_component(spark):
    docs = cases.documents(spark)
    kept = simhash.near_dedup(docs).collect()
    found = simhash.simhash_components(docs).select("component").distinct().count()
    assert len(kept) == found
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r["doc_id"] for r in simhash.near_dedup(plain).collect()}
    assert kept == {r["component_id"] for r in simhash.simhash_components(plain).collect()}


def test_empty_and_clashing(spark):
    assert simhash.simhash_components(cases.empty(spark)).collect() == []
    assert simhash.near_dedup(cases.empty(spark)).collect() == []
    docs = cases.clashing(spark)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3}
