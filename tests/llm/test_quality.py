import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality as q
from tests.llm import cases

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def given(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet").repartition(8), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def machine(given):
    return q.train_quality(*given)


@pytest.mark.parametrize("seed", range(5))
def test_score_equals_the_sum_over_pairs(seed):
    rng = np.random.default_rng(seed)
    machine = q.Machine(0.3, rng.normal(size=q.SLOTS).astype(np.float32), rng.normal(size=(q.SLOTS, q.FACTORS)).astype(np.float32))
    f = q.features(["One two two three, one. 12 %", "", "ß é one\none\n\n", "x " * 30], [10, None, 3, 0])
    raw, _, _ = machine.parts(f)
    ends = [*f.starts[1:], f.slots.size]
    for row, (b, e) in enumerate(zip(f.starts, ends)):
        x = dict(zip(f.slots[b:e].tolist(), f.values[b:e].tolist()))
        assert len(x) == e - b
        pairs = sum(float(machine.factors[i] @ machine.factors[j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
        assert raw[row] == pytest.approx(0.3 + sum(float(machine.linear[i]) * v for i, v in x.items()) + pairs, rel=1e-3, abs=1e-3)


def test_gradient_of_the_fit():
    """A step of the fit goes down the loss: the machine learns a rule that only pairs of words can tell (a or b, not both)."""
    texts, label = [], []
    for n in range(400):
        a, b = n % 2, n // 2 % 2
        texts.append("left " * a + "right " * b + "same")
        label.append(a ^ b)
    f = q.features(texts, [None] * len(texts))
    p = q.fit(f, np.array(label, float), np.ones(len(texts))).probability(f)
    assert ((p >= 0.5) == np.array(label)).all()


def test_words_of_a_text_by_definition():
    text = "Red red blue — GREEN 7"
    f = q.features([text], [None])
    counted = {}
    for w, n in ((b"red", 2), (b"blue", 1), (b"green", 1), (b"7", 1)):
        slot = zlib.crc32(w) & (q.WORDS - 1)
        counted[slot] = counted.get(slot, 0) + np.log1p(n)
    norm = sum(v * v for v in counted.values()) ** 0.5
    got = {s: v for s, v in zip(f.slots.tolist(), f.values.tolist()) if s < q.WORDS}
    assert got == pytest.approx({s: v / norm for s, v in counted.items()}, rel=1e-5)
    assert (f.slots >= q.WORDS).sum() == len(q.STATISTICS)


def test_chunks_change_nothing(monkeypatch):
    texts, stated = ["one two", None, "three " * 500, "", "four"], [1, None, 5, 0, 2]
    whole = q.features([t or "" for t in texts], stated)
    monkeypatch.setattr(q, "CHUNK", 1)
    parts = [*q.chunks(texts, stated)]
    assert len(parts) > 1
    assert np.concatenate([p.slots for p in parts]).tolist() == whole.slots.tolist()
    assert np.concatenate([p.values for p in parts]) == pytest.approx(whole.values)


def test_held_out_accuracy(given, machine):
    docs, labels = given
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    scored = q.score_quality(docs.join(held.select("doc_id"), "doc_id", "leftsemi"), machine).join(held, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in scored)
    good = np.array([r["quality"] for r in scored]) == 1
    predicted = np.array([r["predicted"] for r in scored]) == 1
    assert (predicted == good).mean() > 0.99 and (~predicted[~good]).mean() > 0.95
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in scored)


def test_learning_ignores_held_out_labels(given, machine):
    docs, labels = given
    turned = labels.withColumn("quality", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = q.train_quality(docs, turned)
    assert again.bias == machine.bias and (again.factors == machine.factors).all()


def test_lang_source_and_id_are_no_inputs(spark, machine):
    docs = spark.createDataFrame([(1, "some words here", "en", "a", 15), (2, "some words here", "de", "b", 15)], cases.SCHEMA)
    assert len({r["score"] for r in q.score_quality(docs, machine).collect()}) == 1


def test_odd_documents_and_tables(spark, machine):
    docs = cases.documents(spark)
    got = q.score_quality(docs, machine).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert q.score_quality(cases.empty(spark), machine).collect() == []
    assert q.score_quality(docs.drop("n_chars"), machine).count() == docs.count()
    none = q.quality_of(docs, cases.empty(spark, LABELS)).collect()
    assert len(none) == docs.count() and {r["predicted"] for r in none} == {0} and not any(r["held_out"] for r in none if r["doc_id"] is None)
    only_good = spark.createDataFrame([(1, 1, None)], LABELS)
    assert {r["predicted"] for r in q.quality_of(docs, only_good).collect()} == {1}
    mixed = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (3, 0, None), (None, 1, 1), (4, 1, 0), (5, 0, 5), (9, 7, 1), (500, 1, 0), (501, 0, 1)], LABELS)
    assert q.quality_of(docs, mixed).count() == docs.count()
    assert q.quality_of(cases.clashing(spark), mixed).count() == 3
    assert q.quality_of(cases.empty(spark), mixed).collect() == []


def test_repeated_ids_teach_once(spark):
    many = spark.createDataFrame([(1, f"good words {n}", "en", "s", n) for n in range(50)] + [(3, "bad", "en", "s", 1)], cases.SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], LABELS)
    once = q.train_quality(many, labels)
    first = spark.createDataFrame([(1, "good words 0", "en", "s", 0), (3, "bad", "en", "s", 1)], cases.SCHEMA)
    assert (q.train_quality(first, labels).factors == once.factors).all()
