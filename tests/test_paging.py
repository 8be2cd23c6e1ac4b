import pytest
from pyspark.sql import functions as F

from factloom.operators import common, paging


@pytest.fixture(scope="module")
def table(spark):
    """Many ties in the first column, nulls in it too; the key settles them."""
    return spark.range(5_000).select(F.when(F.col("id") % 50 != 0, (F.col("id") * 37 % 11).cast("int")).alias("score"), F.concat(F.lit("k"), F.col("id")).alias("key"))


ORDERS = [lambda: [F.desc("score"), F.asc("key")], lambda: [F.asc_nulls_last("score"), F.desc("key")]]


@pytest.mark.parametrize("order", [0, 1])
def test_pages_equal_the_sorted_table(table, order):
    index = paging.build_page_index(table, ORDERS[order](), 300)
    assert index.total == 5_000 and len(index.size) > 10
    whole = [tuple(r) for r in table.orderBy(*ORDERS[order]()).collect()]
    for limit, offset in ((10, 0), (50, 4_321), (7, 4_995), (5, 6_000), (900, 1_000), (0, 3)):
        assert [tuple(r) for r in paging.page_at(index, limit, offset).collect()] == whole[offset:offset + limit]
    assert [tuple(r) for r in common.page(table, ORDERS[order](), 50, 4_321).collect()] == whole[4_321:4_371]


def test_a_deep_page_reads_its_ranges_only(table):
    index = paging.build_page_index(table, ORDERS[0](), 300)
    assert len(index.ranges(20, 4_000)) <= 2
    plan = paging.page_at(index, 20, 4_000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_table(table):
    index = paging.build_page_index(table.where("false"), ORDERS[0]())
    assert index.total == 0 and paging.page_at(index, 10).collect() == []
