import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import toxicity as tox
from tests.llm import cases


def brute_segments(scores):
    """Maximal scoring segments by definition: take the best-scoring one (the shortest), then go on left and right of it."""
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and best[0] > 0 and j + 1 - i < best[2] - best[1]):
                best = (total, i, j + 1)
    if best[0] <= 0:
        return []
    _, i, j = best
    right = [(s + j, e + j, v) for s, e, v in brute_segments(scores[j:])]
    return [*brute_segments(scores[:i]), (i, j, best[0]), *right]


@pytest.mark.parametrize("seed", range(60))
def test_segments_equal_the_definition(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-1, 1]) * rng.uniform(0.1, 5) for _ in range(rng.randrange(0, 40))]
    got = [(s, e, round(v, 6)) for s, e, v in tox.segments(scores)]
    assert got == [(s, e, round(v, 6)) for s, e, v in brute_segments(scores)]


def test_segments_are_linear():
    assert len(tox.segments([1.0, -2.0] * 200_000)) == 200_000
    assert tox.segments([1.0] * 1000) == [(0, 1000, 1000.0)] or sum(v for *_, v in tox.segments([1.0] * 1000)) == 1000


@pytest.fixture(scope="module")
def given(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet").repartition(8), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def model(given):
    return tox.train_toxicity(*given)


def test_held_out_accuracy(given, model):
    docs, labels = given
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    scored = tox.score_toxicity(docs.join(held.select("doc_id"), "doc_id", "leftsemi"), model).join(held, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in scored)
    toxic = np.array([r["toxic"] for r in scored]) == 1
    predicted = np.array([r["predicted"] for r in scored]) == 1
    assert predicted[toxic].mean() > 0.9 and predicted[~toxic].mean() < 0.01
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in scored)


def test_learning_ignores_held_out_labels(given, model):
    docs, labels = given
    turned = labels.withColumn("toxic", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tox.train_toxicity(docs, turned)
    assert again.scores == model.scores and abs(again.offset - model.offset) < 1e-6


def test_passages_have_places(model):
    word = max((w for w in model.scores if not w.endswith(b"*")), key=model.scores.get).decode()
    clean = "this and that " * 20
    (found,) = model.passages(f"{clean} {word} {word} {clean}")
    assert found[:2] == (60, 62)
    assert model.passages(clean) == [] and model.passages(None) == []


def test_two_passages_count_apart(model):
    word = max((w for w in model.scores if not w.endswith(b"*")), key=model.scores.get).decode()
    far = f"{word} {word} " + "this and that " * 2000 + f"{word} {word}"
    assert len(model.passages(far)) >= 1
    assert model.probability(far) > 0.5 > model.probability("this and that " * 2000)


def test_odd_documents_and_tables(spark, model):
    docs = cases.documents(spark)
    got = tox.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert tox.score_toxicity(cases.empty(spark), model).collect() == []
    labels = "doc_id long, quality int, toxic int"
    none = tox.toxicity_of(docs, cases.empty(spark, labels)).collect()
    assert len(none) == docs.count() and {r["predicted"] for r in none} == {0}
    mixed = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, None), (None, 1, 1), (9, 1, 0), (11, 0, 5)], labels)
    assert tox.toxicity_of(docs, mixed).count() == docs.count()
    assert tox.toxicity_of(cases.clashing(spark), mixed).count() == 3


def test_passage_table(spark, model):
    word = max((w for w in model.scores if not w.endswith(b"*")), key=model.scores.get).decode()
    docs = spark.createDataFrame([(1, f"so {word} {word} it is"), (2, "so it is"), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["first_word"], r["last_word"]) for r in tox.toxic_passages(docs, model).collect()] == [(1, 1, 2)]
