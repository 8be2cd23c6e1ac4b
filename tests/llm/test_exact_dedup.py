import hashlib
import re

import duckdb

from factloom.llm import exact_dedup
from factloom.llm.queries import OP8_SQL
from tests.llm import cases


def brute(rows):
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out, seen = [], set()
    for (doc, _), b in zip(rows, body):
        ids = [d for (d, _), x in zip(rows, body) if x == b]
        keep = min((d for d in ids if d is not None), default=None)
        first = (doc, b) not in seen
        seen.add((doc, b))
        out.append((doc, keep, len(ids), doc == keep and first, hashlib.sha256(b.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_report_equals_brute_force(spark):
    docs = cases.documents(spark)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    for prefix in (1, 256):
        assert order(tuple(r) for r in exact_dedup.dedup_report(docs, prefix).collect()) == order(want)


def test_equal_length_and_prefix_do_not_make_a_group(spark):
    docs = spark.createDataFrame([(1, "abcd"), (2, "abce"), (3, "abcd"), (4, "zzzz")], "doc_id long, text string")
    assert {(r["digest"][:4], r["doc_id"]) for r in exact_dedup.exact_groups(docs, 3).collect()} == {
        (hashlib.sha256(b"abcd").hexdigest()[:4], 1), (hashlib.sha256(b"abcd").hexdigest()[:4], 3)}


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = [tuple(r) for r in con.execute(OP8_SQL).fetchall()]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert order(tuple(r) for r in exact_dedup.dedup_report(docs).collect()) == order(want)


def test_filter_keeps_whole_rows(spark):
    docs = cases.documents(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    want = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for (d, t), r in zip(
        [tuple(r) for r in docs.select("doc_id", "text").collect()], brute([tuple(r) for r in docs.select("doc_id", "text").collect()])) if r[3]]
    assert order((r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in kept.collect()) == order(want)


def test_empty_and_clashing(spark):
    assert exact_dedup.dedup_report(cases.empty(spark)).collect() == []
    assert exact_dedup.exact_dedup(cases.empty(spark)).collect() == []
    docs = cases.clashing(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3}
