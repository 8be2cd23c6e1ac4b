import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import sequence


def brute(texts, max_chars):
    out, held, used = [], [], 0
    for t in texts:
        t = (t or "").strip()
        if not t:
            continue
        if held and used + len(t) > max_chars:
            out.append("\n".join(held))
            held, used = [], 0
        held.append(t)
        used += len(t) + 1
    return out + (["\n".join(held)] if held else [])


def documents(rng):
    docs = {d: [rng.choice([" ", "", None, "x", "y" * rng.randrange(1, 9), "z" * rng.randrange(1, 60)]) for _ in range(rng.randrange(0, 90))] for d in range(12)}
    docs[20], docs[21], docs[None] = ["a"] * 200, ["bb", "c" * 100, "d", "e" * 100] * 9, ["n1", "n2"]
    return docs


@pytest.mark.parametrize("width,max_chars", [(1, 10), (4, 30), (7, 30), (16, 100), (1024, 30), (5, 1)])
def test_slices_equal_the_fold(spark, width, max_chars):
    docs = documents(random.Random(width * max_chars))
    rows = [(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, page_or_index int, text string").repartition(5)
    got = {}
    for r in sequence.chunk_blocks(df, max_chars=max_chars, width=width).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["chunk"]
    want = {d: dict(enumerate(brute(texts, max_chars), 1)) for d, texts in docs.items() if brute(texts, max_chars)}
    assert got == want


def test_rows_of_texts_equal_the_fold(spark):
    docs = documents(random.Random(9))
    df = spark.createDataFrame([(d, t) for d, t in docs.items()] + [(99, None)], "doc_id int, texts array<string>")
    got = {}
    for r in sequence.chunk_documents(df, "doc_id", F.col("texts"), 30).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["chunk"]
    assert got == {d: dict(enumerate(brute(t, 30), 1)) for d, t in docs.items() if brute(t, 30)}


def test_one_long_document_is_spread(spark):
    """200 000 blocks of one document: each row that any stage holds is a slice, a summary or a chunk."""
    df = spark.range(200_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page_or_index"), F.concat(F.lit("block "), F.col("id")).alias("text"))
    out = sequence.chunk_blocks(df)
    texts = [f"block {i}" for i in range(200_000)]
    got = {r["chunk_no"]: r["chunk"] for r in out.collect()}
    assert got == dict(enumerate(brute(texts, 3000), 1))
