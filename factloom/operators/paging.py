"""Deep pages of an ordered table: stored in ranges of rows, so that any page reads the one or two ranges it lies in."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import scratch_path

RANGE_ROWS = 100_000  # rows of a range, about


@dataclass(frozen=True)
class PageIndex:
    """Rows stored by range of the order, and for each range the number of its first row and of its rows."""

    rows: DataFrame
    order: tuple[Column, ...]
    first: tuple[int, ...]
    size: tuple[int, ...]

    @property
    def total(self) -> int:
        return sum(self.size)

    def ranges(self, limit: int, offset: int) -> list[int]:
        """The ranges that a page lies in."""
        return [i for i, (f, n) in enumerate(zip(self.first, self.size)) if n and f < offset + limit and f + n > offset]


def build_page_index(df: DataFrame, order, range_rows: int = RANGE_ROWS) -> PageIndex:
    """Store ``df`` in ranges of ``order`` (columns with their direction). The order should name each row; equal rows may change places between pages.

    Rows are dealt by a sample of the order and counted per range afterwards, so ranges need not be of one size. What stays on the
    driver is one pair of numbers per range.
    """
    order = tuple(order)
    n = 1 + df.count() // range_rows
    path = scratch_path(df.sparkSession, "pages")
    dealt = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(path)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(path)
    found = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = tuple(found.get(i, 0) for i in range(n))
    return PageIndex(rows, order, tuple(accumulate(size[:-1], initial=0)), size)


def page_at(index: PageIndex, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order, in order; nothing beyond the last row."""
    own = index.ranges(limit, offset)
    part = index.rows.where(F.col("_range").isin(own) if own else F.lit(False))
    start = index.first[own[0]] if own else 0
    # The ranges of one page are few, and follow each other.
    number = F.row_number().over(Window.orderBy("_range", *index.order)) - 1 + start
    inside = part.withColumn("_number", number).where((F.col("_number") >= offset) & (F.col("_number") < offset + limit))
    return inside.orderBy("_number").drop("_number", "_range")
