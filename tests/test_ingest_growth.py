"""The ingest moves documents and facts between tasks only where they have to meet."""

from __future__ import annotations

from factloom.operators.extraction import dedupe_facts, extract_text_facts
from factloom.sources.blocks import text_blocks
from factloom.streaming import ingest
from tests.test_facts import VOCAB

DOCS = "doc_id string, text string, file_name string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_of_a_text_are_made_distinct_without_a_shuffle(spark):
    texts = ["济南 GDP总量 3亿元", "GDP总量 3亿元" + " " * 60 + "GDP总量 3亿元" + " " * 60, "GDP总量 5 亿元，济南 GDP总量 ５ 亿元。" * 3 + "常住人口 10万人，" * 4, "", "无"]
    same = "，" * 30 + "GDP总量 7亿元" + "，" * 30
    docs = spark.createDataFrame([(str(n), t, "济南") for n, t in enumerate([*texts, same * 3, same + "济南" + same])], DOCS)
    blocks = text_blocks(docs, keep=("file_name",))
    got = ingest.text_pipeline(VOCAB).to_facts(blocks)
    assert "Window" not in plan(got) and "hashpartitioning" not in plan(got)
    every = extract_text_facts(blocks, VOCAB)
    want = sorted(r["fact_id"] for r in dedupe_facts(every).collect())
    assert sorted(r["fact_id"] for r in got.collect()) == want and len(want) < every.count()


def test_documents_that_come_once_are_not_moved(spark):
    docs = spark.createDataFrame([("1", "x", "a"), ("2", None, "a"), (None, "y", "a")], DOCS)
    assert "Join" not in plan(ingest.one_version(docs))
    twice = docs.unionByName(docs)
    assert sorted(map(tuple, ingest.one_version(twice).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_counts_of_documents(spark):
    ids = spark.createDataFrame([("1",), ("1",), ("2",), ("3",), (None,)], "doc_id string")
    blocks = spark.createDataFrame([("1", None), ("1", None), ("2", "bad"), ("2", None), (None, None), ("9", None)], "doc_id string, error string")
    facts = spark.createDataFrame([("1",), ("1",), ("1",), (None,)], "source_doc_id string")
    got = ingest.document_counts(ids, blocks, facts)
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "parsed", 2, 3), ("2", "failed", 0, 0), ("3", "parsed", 0, 0), (None, "parsed", 0, 0)]
    assert "Join" not in plan(got)


def test_only_rows_that_a_later_batch_may_replace_are_looked_up(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 2), ("d", 1), (None, 2)], "source_doc_id string, batch_id long")
    moved = ingest.Moved(spark.createDataFrame([("a", 1), ("d", 2)], "m_doc string, m_batch long"), 2, 2)
    read = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert read(ingest._counting(rows, moved)) == [("a", 1), ("b", 0), ("c", 2)]
    assert read(ingest._replaced(rows, moved)) == [("a", 0), ("d", 1), (None, 2)]
    none = ingest.Moved(spark.createDataFrame([], "m_doc string, m_batch long"), 2, 0)
    assert "Join" not in plan(ingest._counting(rows, none))
