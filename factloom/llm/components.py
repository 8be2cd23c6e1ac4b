"""Connected components of a stored edge table by alternating stars; no group is ever held by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import stored


def _parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _clean(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, once each."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = stored(_clean(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
    least = _parents(large)
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(_clean(small.unionByName(least.select("u", F.col("m").alias("v")))), "small")


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)``: label is the smallest node that can be reached.

    Large stars link the larger neighbours of a node to its smallest one, small stars link all smaller ones; the
    rounds end when nothing changes. Minima are combined before the shuffle, joins may be split. Self loops and
    repeated edges do no harm; an empty table gives no rows.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    edges = stored(_clean(edges.select("u", "v")), "edges")
    state = _state(edges)
    while state[0]:
        edges = _round(edges)
        now = _state(edges)
        if now == state:
            break
        state = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"))
