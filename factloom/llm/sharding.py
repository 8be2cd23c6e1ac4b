"""Hierarchical weighted hash tree: regions, racks and shards chosen by weighted hash draws.

The tree is a parameter: ``(region, rack, shard, weight)`` per shard. A key descends it. On each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's name, and the smallest draw wins, so a child gets keys in
proportion to its weight (the sum of the weights below it). A draw depends on nothing but the key, the child and its
weight: raising a weight only moves keys into that child, lowering one only out of it, and below an unchanged
subtree nothing moves. Native column expressions throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import stored

Tree = Sequence[tuple[str, str, int, float]]
HELPER = "__factloom_"  # of columns beside a caller's own
DRAW = f"{HELPER}draw"


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards of weight 1 in full racks and regions."""
    return [(f"region{s // (per_rack * racks)}", f"rack{s // per_rack % racks}", s, 1.0) for s in range(shards)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, as a region of its own: no weight of another subtree changes, so rows move only into it."""
    number = max((s for _, _, s, _ in tree), default=-1) + 1
    return [*tree, (f"added{number}", "rack0", number, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _least(key: Column, children: dict[str, float]) -> Column:
    """Name of the child with the smallest draw."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    drawn = [F.struct(_draw(key, name, w).alias("draw"), F.lit(name).alias("name")) for name, w in children.items()]
    return F.least(*drawn)["name"]


def _by_first(entries: list[tuple[tuple, float]]) -> dict[str, list[tuple[tuple, float]]]:
    groups: dict[str, list[tuple[tuple, float]]] = {}
    for path, weight in entries:
        groups.setdefault(path[0], []).append((path[1:], weight))
    return groups


def with_shard(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Add the shard of ``key`` (null is a key of its own) by descending the tree; helper columns do not stay.

    Repeated keys go to one shard; a column named ``out`` is replaced, any other stays as it is.
    """
    if not tree:
        raise ValueError("a tree needs a shard")
    if len({s for _, _, s, _ in tree}) < len(tree) or min(w for *_, w in tree) < 0 or not sum(w for *_, w in tree):
        raise ValueError("shards must be distinct, weights not negative and not all 0")
    entries = [((region, rack, str(shard)), weight) for region, rack, shard, weight in tree if weight]
    hashed = F.struct(F.col(key).cast("string").alias("k"), F.col(key).isNull().alias("none"))
    df = df.withColumn(DRAW, F.xxhash64(hashed["k"], hashed["none"]))

    def named(prefix: str, group: list) -> dict[str, float]:
        return {f"{prefix}/{name}": sum(w for _, w in below) for name, below in _by_first(group).items()}

    steps = [f"{HELPER}region", f"{HELPER}rack", f"{HELPER}leaf"]
    chosen = {"": entries}
    for step, above in zip(steps, [None, *steps]):
        branches, nxt = None, {}
        for prefix, group in chosen.items():
            pick = _least(F.col(DRAW), named(prefix, group))
            for name, below in _by_first(group).items():
                nxt[f"{prefix}/{name}"] = below
            if above is None:
                branches = pick
            else:
                branches = (F.when if branches is None else branches.when)(F.col(above) == prefix, pick)
        df, chosen = df.withColumn(step, branches), nxt
    return df.withColumn(out, F.element_at(F.split(steps[-1], "/"), -1).cast("int")).drop(DRAW, *steps)


def assign_shards(docs: DataFrame, tree: Tree, more: Tree | None = None, *, slice_rows: int = 20_000) -> DataFrame:
    """Shard, slot, size and checksum of every row of ``docs(doc_id, text)``; texts are not moved.

    ``more`` is a second tree (null: none) whose shard is given as ``grown_shard``. Slots number the rows of a shard
    from 0 without gaps. They are dealt slice by slice: a row falls into one of the shard's slices, rows are numbered
    inside their slice, and a slice starts where the slices before it end, so no task orders a shard. A null
    text has size 1 and the checksum of no bytes. Repeated ids go to the same shard, in slots of their own.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id"), (F.length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"))
    rows = with_shard(rows, "doc_id", tree, "shard")
    rows = with_shard(rows, "doc_id", more, "grown_shard") if more else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    # Written once: both the counts and the numbering below must see the same row numbers.
    rows = stored(rows, "shards")
    slices = max(1, -(-rows.count() // (slice_rows * len(tree))))
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices)).cast("int"))
    sizes = cut.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("shard").alias("_shard"), F.col("_slice").alias("_cut"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_slice").orderBy("doc_id", "_row"))
    return (
        cut.withColumn("_inside", inside.cast("long") - 1)
        .join(offsets, (F.col("shard") == F.col("_shard")) & (F.col("_slice") == F.col("_cut")))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("_inside") + F.col("_before")).alias("slot"), "grown_shard")
    )
