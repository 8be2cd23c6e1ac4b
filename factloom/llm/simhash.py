"""SimHash near-duplicates: 64-bit fingerprints linked by a self-join over their binary trie."""

from __future__ import annotations

import functools
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from factloom.llm.components import components
from factloom.llm.shared import in_batches, small_side, stored

SEED = 42
ID, FP = "__factloom_id", "__factloom_fp"  # helper columns beside a caller's own
BITS = 64
FRONTIER = 1 << 20  # node pairs expanded at once; a larger frontier is worked off in parts
RUN = 1 << 16  # shingles whose bits are unpacked at once


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, as unsigned 64-bit; 0 without words.

    A-Z are lowered, words are runs of other bytes than space and \\x09-\\x0D. Fewer words than ``width`` are one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, SEED)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    count = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, RUN):
        hashes = np.array([digest(joined[s:e - 1], SEED) for s, e in zip(starts[at:min(at + RUN, count)], starts[at + width:])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs(doc_id, text)``; fp holds the 64 bits, null texts count as empty."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(t or b"", width) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(found, np.uint64).view(np.int64))}

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")),
                      rows, "doc_id long, fp long")


# ---------------------------------------------------------------- trie self-join


class _Trie:
    """Levels of the binary trie over sorted distinct values, made when first asked for."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self._levels: dict[int, tuple] = {}
        self._children: dict[int, np.ndarray] = {}

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes of the nodes, and the place of the value where a node holds one only (else -1)."""
        if depth not in self._levels:
            shifted = self.values >> np.uint64(BITS - depth) if depth else np.zeros_like(self.values)
            first = np.flatnonzero(np.concatenate([[True], shifted[1:] != shifted[:-1]]))
            counts = np.diff(np.append(first, shifted.size))
            self._levels[depth] = shifted[first], np.where(counts == 1, first, -1)
        return self._levels[depth]

    def children(self, depth: int) -> np.ndarray:
        """Places of a node's two children on the next level, -1 where there is none."""
        if depth not in self._children:
            above, below = self.level(depth)[0], self.level(depth + 1)[0]
            kids = np.full((above.size, 2), -1, np.int64)
            kids[np.searchsorted(above, below >> np.uint64(1)), (below & np.uint64(1)).astype(np.int64)] = np.arange(below.size)
            self._children[depth] = kids
        return self._children[depth]


class _Sets:
    """Disjoint sets with arrays: links are joined in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while u.size:
            a, b = self.root[u], self.root[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            self.root[np.maximum(a, b)] = np.minimum(a, b)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two subtries (None: within the one) whose nodes lie ``depth`` bits below the root.

    Returns (values, smallest linked value reached): every value that some link touches, beside the representative of its
    set. Two nodes are walked down together; each level adds the bits in which they differ, a pair over the budget is
    dropped, and where both hold one value the remaining bits are compared at once.
    """
    own = right is None
    values = left if own else np.concatenate([left, right])
    if not left.size or not values.size - (0 if own else left.size):
        return values[:0], values[:0]
    a = _Trie(left)
    b = a if own else _Trie(right)
    shift = 0 if own else left.size
    sets, touched = _Sets(values.size), np.zeros(values.size, bool)
    above = 0 if own or not depth else int(np.bitwise_count((left[0] ^ right[0]) >> np.uint64(BITS - depth)))
    if above > budget:
        return values[:0], values[:0]
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, above, np.int8))]
    while stack:
        level, x, y, err = stack.pop()
        if x.size > FRONTIER:
            for at in range(0, x.size, FRONTIER // 2):
                part = slice(at, at + FRONTIER // 2)
                stack.append((level, x[part], y[part], err[part]))
            continue
        p, q = a.level(level)[1][x], b.level(level)[1][y]
        single = (p >= 0) & (q >= 0)
        if single.any():
            p, q = p[single], q[single]
            near = np.bitwise_count(a.values[p] ^ b.values[q]) <= budget
            if own:
                near &= p != q
            p, q = p[near], q[near] + shift
            touched[p] = touched[q] = True
            sets.link(p, q)
            x, y, err = x[~single], y[~single], err[~single]
        if not x.size:
            continue
        xs, ys, es = [], [], []
        kids_a, kids_b = a.children(level)[x], b.children(level)[y]
        for i in (0, 1):
            for j in (0, 1):
                cx, cy, ce = kids_a[:, i], kids_b[:, j], err + (i != j)
                alive = (cx >= 0) & (cy >= 0) & (ce <= budget)
                if own and i > j:
                    alive &= x != y  # both orders of a node with itself are one
                xs.append(cx[alive])
                ys.append(cy[alive])
                es.append(ce[alive])
        stack.append((level + 1, np.concatenate(xs), np.concatenate(ys), np.concatenate(es)))
    at = np.flatnonzero(touched)
    return values[at], values[sets.root[at]]


STEP = 4  # bits that crowded pairs of nodes are taken down at once


def _prefix(fp, depth: int):
    return F.shiftrightunsigned(fp, BITS - depth) if depth < BITS else F.col(fp)


def _node_pairs(distinct: DataFrame, budget: int, subtrie: int, least_depth: int) -> dict[int, DataFrame]:
    """Pairs of trie nodes to compare whole, by depth: ``(a, b)`` with a <= b, of nodes that exist and stay within the budget.

    Nodes carry the number of their fingerprints. A pair that holds more than ``2 * subtrie`` of them is crowded and replaced by the
    pairs of its nodes ``STEP`` bits further down, so each pair that is left is small, however the fingerprints lie.
    """
    pairs, done, depth = None, {}, least_depth
    while True:
        counts = distinct.groupBy(_prefix("fp", depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        if pairs is not None:
            crowded_nodes = pairs.select(F.explode(F.array("pa", "pb")).alias("up")).distinct()
            counts = counts.join(small_side(stored(crowded_nodes, "crowded"), 16), F.shiftrightunsigned("node", STEP) == F.col("up"), "leftsemi")
        counts = stored(counts, "nodes")
        a, b = (counts.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
        fits = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget
        if pairs is None:
            # At most 2^least_depth nodes.
            walked = a.join(F.broadcast(b), (F.col("a") <= F.col("b")) & fits)
        else:
            # Children of two nodes meet in one order, those of one node in both: there the smaller comes first.
            once = (F.col("pa") != F.col("pb")) | (F.col("a") <= F.col("b"))
            a, b = (side.withColumn(f"up_{x}", F.shiftrightunsigned(x, STEP)) for side, x in ((a, "a"), (b, "b")))
            walked = pairs.join(a, F.col("pa") == F.col("up_a")).join(b, (F.col("pb") == F.col("up_b")) & once & fits)
        total = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        walked = stored(walked.select("a", "b", total.alias("n")), "node-pairs")
        crowded = F.col("n") > 2 * subtrie if depth < BITS else F.lit(False)
        done[depth] = walked.where(~crowded).select("a", "b")
        pairs = walked.where(crowded).select(F.col("a").alias("pa"), F.col("b").alias("pb"))
        if pairs.isEmpty():
            return done
        depth += STEP


def trie_self_join(distinct: DataFrame, budget: int = 3, subtrie: int = 1 << 16, least_depth: int = 4) -> DataFrame:
    """Edges ``(u, v)`` over ``distinct(fp)`` that connect exactly the fingerprints within ``budget`` differing bits.

    The top of the trie is walked over the counts of its nodes: nodes form pairs, a pair over the budget or with a node that does not exist is
    never made, and a pair is taken further down until it holds at most ``2 * subtrie`` fingerprints. Each such pair of subtries
    is one group, so no group grows with the table, also where many fingerprints share a long prefix. A group gives the
    sets it links (at most one edge per value), not all its pairs.
    """
    found = []
    for depth, pairs in _node_pairs(distinct, budget, subtrie, least_depth).items():
        ends = pairs.withColumn("node", F.explode(F.array_distinct(F.array("a", "b"))))
        if pairs.isEmpty():
            continue
        members = distinct.withColumn("node", _prefix("fp", depth)).join(small_side(ends, 48), "node").select("a", "b", "fp")
        found.append(members.withColumn("depth", F.lit(depth)))

    def links(group: pa.Table) -> pa.Table:
        depth, low, high = (group.column(c)[0].as_py() for c in ("depth", "a", "b"))
        values = np.sort(group.column("fp").to_numpy().view(np.uint64))
        if low == high:
            u, v = trie_links(values, None, depth, budget)
        else:
            # Prefixes of all 64 bits are signed numbers here, so the smaller one may be the later one.
            first = values >> np.uint64(BITS - depth) == np.uint64(low & ((1 << BITS) - 1)) if depth else np.ones(values.size, bool)
            u, v = trie_links(values[first], values[~first], depth, budget)
        apart = u != v
        return pa.table({"u": pa.array(u[apart].view(np.int64)), "v": pa.array(v[apart].view(np.int64))})

    if not found:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    return functools.reduce(DataFrame.unionByName, found).groupBy("depth", "a", "b").applyInArrow(links, "u long, v long")


# ---------------------------------------------------------------- operator


def simhash_components(docs: DataFrame, budget: int = 3, width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id, component)`` of every row of ``docs(doc_id, text)``.

    Documents link when their fingerprints differ in at most ``budget`` bits; component_id is the smallest doc_id that
    can be reached (null only where the whole component has null ids), component the smallest fingerprint. Equal fingerprints are joined once, as
    one node, however many documents share them. Null, empty and wordless texts have fingerprint 0, linked like any other. Repeated rows are
    returned as often as they occur.
    """
    rows = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    edges = stored(trie_self_join(nodes.select("fp"), budget), "links")
    labels = components(edges).withColumnsRenamed({"node": "fp"})
    labelled = stored(nodes.join(labels, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label")), "labels")
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = labelled.join(smallest, "label").select("fp", "component_id", "label")
    return rows.join(of_fp, "fp").select("doc_id", hex_of("fp").alias("fingerprint"), "component_id", hex_of("label").alias("component"))


def hex_of(fp):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@F.pandas_udf(LongType())
def _fingerprint_column(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t or b"") for t in text], np.uint64).view(np.int64))


def near_dedup(docs: DataFrame, budget: int = 3) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; all columns stay as they are.

    Ids that name several rows (null among them) are settled by id and fingerprint, of which one row stays; a component
    whose ids are all null keeps one of its rows.
    """
    found = stored(simhash_components(docs, budget), "components")
    several = stored(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(ID)), "several")
    same = F.col("doc_id").eqNullSafe(F.col(ID))
    lost = small_side(found.where("doc_id <> component_id").select(F.col("doc_id").alias(ID)).unionByName(several), 32)
    kept = docs.join(lost, same, "leftanti")
    if several.isEmpty():
        return kept
    winners = (found.join(several, same, "leftsemi").where("doc_id <=> component_id")
               .groupBy("component").agg(F.min_by(F.struct("doc_id", "fingerprint"), "fingerprint").alias("w"))
               .select(F.col("w.doc_id").alias(ID), F.col("w.fingerprint").alias(FP)))
    rest = docs.join(several, same, "leftsemi").withColumn(FP + "_", hex_of(_fingerprint_column(F.col("text").cast("binary"))))
    rest = rest.join(winners, same & (F.col(FP + "_") == F.col(FP)), "leftsemi").dropDuplicates(["doc_id", FP + "_"])
    return kept.unionByName(rest.select(docs.columns))
