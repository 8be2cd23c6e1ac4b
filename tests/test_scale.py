"""Properties that matter when one group is very large."""

from __future__ import annotations

import contextlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import common, matching, sequence
from factloom.plans import catalog
from factloom.session import TooLarge, take_bounded

QUERIES = catalog.QUERIES


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    k = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int")
    return spark.range(3000).select(k.alias("k"), ((F.col("id") * 7919) % 100003).alias("pos"), F.col("id"))


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("width", [1, 64, 1000, 10**6])
def test_rank_by_position_equals_row_number(skewed, width):
    got = common.rank_by_position(skewed, "pos", ["k"], "r", width)
    want = skewed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("pos")))
    assert same(got.select("id", "r"), want.select("id", "r"))


def test_rank_without_keys(skewed):
    got = common.rank_by_position(skewed, "pos", (), "r", 500)
    want = skewed.withColumn("r", F.row_number().over(Window.orderBy("pos")))
    assert same(got.select("id", "r"), want.select("id", "r"))


@pytest.mark.parametrize("width", [1, 100, 10**6])
def test_carry_forward_equals_last(skewed, width):
    value = F.when(F.col("id") % 5 == 0, F.col("id"))
    got = common.carry_forward(skewed, ["k"], "pos", {"v": value}, width)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("v", F.last(value, ignorenulls=True).over(w))
    assert same(got.select("id", "v"), want.select("id", "v"))


def test_top_per_group_limits_before_the_shuffle(skewed):
    plan = plan_of(common.top_per_group(skewed, ["k"], [F.desc("pos")], 3))
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"incremental_ingest", "ingest_progress", "export_filled_cells"}))
def test_no_query_crosses_tables(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in plan
    # Outer, semi and anti joins on a key that is constant in the fixture may be planned as
    # nested loops against the few rows with that key; pairs of tables never are.
    assert not re.search("NestedLoopJoin (Inner|Cross)", plan)


def test_bounds_are_checked(spark):
    with pytest.raises(TooLarge):
        take_bounded(spark.range(11), 10, "test")


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_chunks_hold_the_whole_text(spark, limit):
    texts = [f"t{i}" * (i % 9 + 1) for i in range(200)] + ["", "  "]
    df = spark.createDataFrame([("d", texts)], "doc_id string, texts array<string>")
    got = [r["chunk"] for r in sequence.chunk_documents(df, "doc_id", F.col("texts"), limit).orderBy("chunk_no").collect()]
    want, buf, n = [], [], 0
    for t in [t.strip() for t in texts if t.strip()]:
        if buf and n + len(t) > limit:
            want.append("\n".join(buf))
            buf, n = [], 0
        buf.append(t)
        n += len(t) + 1
    want.append("\n".join(buf))
    assert got == want
    assert "\n".join(got).split("\n") == [t for t in texts if t.strip()]


def test_vector_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8)).astype("float32")
    m[17] = 0
    q = rng.normal(size=(4, 8))
    blocks = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(m)], "vec_id long, doc_id int, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in matching.vector_topk(blocks, queries, 7, block_id="vec_id").collect()}
    norm = np.linalg.norm(m.astype(float), axis=1)
    norm[norm == 0] = np.inf
    scores = (q / np.linalg.norm(q, axis=1)[:, None]) @ (m.astype(float) / norm[:, None]).T
    for j in range(4):
        order = [i for i in np.argsort(-scores[j], kind="stable") if i != 17][:7]
        assert [got[j, k + 1] for k in range(7)] == order


def test_history_keeps_whole_short_conversations(spark):
    rows = [("a", i) for i in range(40)] + [("b", i) for i in range(41)]
    df = spark.createDataFrame(rows, "conv_id string, turn int")
    got = {r["conv_id"]: (r["n"], r["lo"]) for r in sequence.trim_history(df).groupBy("conv_id").agg(
        F.count("*").alias("n"), F.min("turn").alias("lo")).collect()}
    assert got == {"a": (40, 0), "b": (30, 11)}
