"""Building blocks that keep ordered work spread out when one group is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialised

# Rows per slice of an ordered group. A group is cut into slices by position; only one
# summary row per slice is ever ordered as a whole.
SLICE = 65_536


def top_per_group(df: DataFrame, keys, order, k: int = 1, rank: str | None = None,
                  kind: str = "row_number") -> DataFrame:
    """First ``k`` rows per group.

    Written as ``row_number() <= k`` so that Catalyst puts a group limit before the
    shuffle: every task sends at most ``k`` rows per group, however large the group is.
    """
    rn = rank or "_rn"
    number = getattr(F, kind)().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn(rn, number).where(F.col(rn) <= k)
    return out if rank else out.drop(rn)


def null_safe(left: DataFrame, right: DataFrame, keys) -> Column:
    """Join condition that treats NULL keys as equal (still a hash or merge join)."""
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def _sliced(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(pos) / width))


def rank_by_position(df: DataFrame, pos: str, keys=(), out: str = "rank",
                     width: int = SLICE) -> DataFrame:
    """Gap-free rank of a unique integer position inside each group.

    Counts per slice are summed up first (one row per slice); rows are then numbered
    inside their slice only, so neither a hot group nor the whole table is one task.
    """
    keys = list(keys)
    cut = _sliced(df, pos, width)
    counts = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = cut.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(pos))
    )
    o = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k_slice"),
                       "_offset")
    cond = F.col("_slice") == F.col("_k_slice")
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return (
        local.join(o, cond)
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("int"))
        .drop("_slice", "_local", "_offset", "_k_slice", *[f"_k_{k}" for k in keys])
    )


def carry_forward(df: DataFrame, keys, pos: str, values: dict[str, Column],
                  width: int = SLICE) -> DataFrame:
    """Last non-NULL value at or before each row of a group, per output column.

    Rows are filled inside their slice; what a slice inherits comes from the ordered
    summaries of the slices before it.
    """
    keys = list(keys)
    cut = _sliced(df, pos, width)
    for name, value in values.items():
        cut = cut.withColumn(f"_v_{name}", value)
    summary = cut.groupBy(*keys, "_slice").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos))).alias(f"_s_{n}")
            for n in values
        ]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = summary.select(
        *keys, "_slice",
        *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_i_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = cut.select(
        "*", *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_l_{n}") for n in values]
    )
    joined = filled.join(inherited, [*keys, "_slice"])
    for name in values:
        joined = joined.withColumn(name, F.coalesce(F.col(f"_l_{name}"), F.col(f"_i_{name}")))
    helpers = [f"_{p}_{n}" for p in "vli" for n in values]
    return joined.drop("_slice", *helpers)


def page(df: DataFrame, order, limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered table (a top-k, never a full sort)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def latest(df: DataFrame, order_by: str, n: int, where: Column | None = None,
           tie: str | None = None) -> DataFrame:
    """The n newest rows."""
    rows = df if where is None else df.where(where)
    return rows.orderBy(F.desc(order_by), *([F.asc(tie)] if tie else [])).limit(n)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, partitions: int) -> DataFrame:
    """Number the rows of each group from 0 in an order, without sorting a group in one task.

    Rows are dealt by ranges of (group, order), written with the number of their range, counted per range, and numbered
    inside it. Rows that are equal in the whole order are numbered in any order among themselves.
    """
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "_tie"]
    cut = materialised(dealt.repartitionByRange(partitions, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_range").alias("_g_range"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_g_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order, "_tie")).cast("long") - 1
    return (cut.withColumn("_inside", inside).join(offsets, same).withColumn(out, F.col("_inside") + F.col("_before"))
            .drop("_tie", "_range", "_inside", "_before", "_g_range", *[f"_g_{g}" for g in group]))
