import numpy as np
import pytest

from factloom.operators import matching, vectors


def clustered(rng, n, dims=12, groups=9):
    centres = rng.normal(size=(groups, dims)) * 4
    rows = [(i, (centres[i % groups] + rng.normal(size=dims) * 0.4).tolist()) for i in range(n)]
    return rows + [(n, [0.0] * dims), (n + 1, None), (n + 2, rows[0][1]), (n + 3, rows[0][1])]


@pytest.mark.parametrize("min_score,members", [(None, 40), (0.9, 40), (-1.0, 40), (None, 10_000), (1.5, 40)])
def test_search_equals_the_scan(spark, min_score, members):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 400)
    blocks = spark.createDataFrame(rows, "block_id int, embedding array<double>")
    asked = [(f"q{i}", rng.normal(size=12).tolist()) for i in range(5)] + [("near", rows[7][1]), ("zero", [0.0] * 12), ("null", None)]
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>")
    index = vectors.build_index(blocks, members=members)
    shape = lambda df: sorted((r["query_id"], r["rank"], r["block_id"], round(r["score"], 9)) for r in df.collect())
    assert shape(vectors.search(index, queries, 7, min_score)) == shape(matching.vector_topk(blocks, queries, 7, min_score))
    share = vectors.share_read(index, queries, 7, min_score)
    assert 0 <= share <= 1
    if min_score == 0.9 and members == 40:
        assert share < 0.5  # clusters too far off are not read


def test_queries_in_blocks_and_empty_tables(spark, monkeypatch):
    rng = np.random.default_rng(4)
    blocks = spark.createDataFrame(clustered(rng, 60), "block_id int, embedding array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(30)], "query_id int, vector array<double>")
    whole = sorted((r["query_id"], r["rank"], r["block_id"]) for r in matching.vector_topk(blocks, queries, 3).collect())
    monkeypatch.setattr(matching, "QUERY_BLOCK", 4)
    assert sorted((r["query_id"], r["rank"], r["block_id"]) for r in matching.vector_topk(blocks, queries, 3).collect()) == whole
    index = vectors.build_index(blocks, members=20)
    assert sorted((r["query_id"], r["rank"], r["block_id"]) for r in vectors.search(index, queries, 3).collect()) == whole
    assert vectors.search(index, queries.where("false"), 3).collect() == []
    assert vectors.search(vectors.build_index(blocks.where("false")), queries, 3).collect() == []


def test_index_over_splits_without_rows(spark):
    """A file with one row group leaves splits of it empty; their tasks have no sums to give."""
    rows = spark.range(0, 40, 1, 40).where("id % 8 = 3").selectExpr("id", "array(CAST(id AS DOUBLE), 1.0D) AS v")
    index = vectors.build_index(rows, "id", "v", members=2)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [r["id"] for r in vectors.search(index, asked, 2).orderBy("rank").collect()] == [35, 27]
