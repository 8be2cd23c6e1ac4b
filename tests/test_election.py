import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import canonical

SCHEMA = ("fact_id string, entity_type string, entity_name string, field_name string, year int, unit string, confidence double, value_num double, "
          "status string, source_doc_id string, metadata map<string,string>")


def random_facts(rng, n, prefix):
    """Facts of few groups, one of which holds a third of them; ties in everything but the id."""
    rows = []
    for i in range(n):
        hot = rng.random() < 0.33
        rows.append((f"{prefix}{i}", "city", "hot" if hot else f"e{rng.randrange(12)}", f"f{rng.randrange(1 if hot else 3)}", None if hot else rng.choice([None, 2020]),
                     rng.choice([None, "USD"]), rng.choice([0.5, 0.9, 0.95, None]), rng.choice([None, 1.0]), rng.choice(["confirmed", "rejected", "pending_review", None]),
                     f"d{rng.randrange(6)}", None))
    return rows


def flags(df):
    return {r["fact_id"]: (r["is_canonical"], r["conflict_group_id"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_changes_equal_a_full_election(spark, seed):
    rng = random.Random(seed)
    early, late = random_facts(rng, 150, "a"), random_facts(rng, rng.choice([0, 5, 80]), "b")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store = canonical.elect_canonical(frame(early)).cache()
    both = canonical.elect_affected(store, frame(late)).cache()
    assert flags(both) == flags(canonical.elect_canonical(frame(early + late)))

    reviews = spark.createDataFrame([(f"{rng.choice('ab')}{rng.randrange(150)}", rng.choice(["confirmed", "rejected"]), "r", None, f"2024-01-{rng.randrange(1, 29):02d}")
                                     for _ in range(60)] + [("none", "rejected", "r", None, "2024")], "fact_id string, status string, reviewer string, note string, reviewed_at string")
    reviewed = canonical.apply_reviews(both, reviews).cache()
    again = canonical.elect_canonical(canonical.apply_latest_reviews(frame(early + late), reviews))
    assert flags(reviewed) == flags(again)
    assert {r["fact_id"]: r["status"] for r in reviewed.collect()} == {r["fact_id"]: r["status"] for r in again.collect()}

    docs = reviewed.select(F.col("source_doc_id").alias("doc_id")).distinct()
    ids = docs.where("doc_id in ('d1', 'd4', 'unknown')")
    _, _, left = canonical.delete_documents(docs, docs, reviewed, ids)
    kept = again.where("source_doc_id not in ('d1', 'd4')")
    assert flags(left) == flags(canonical.elect_canonical(kept))


def test_insert_never_moves_facts_by_group(spark):
    rows = random_facts(random.Random(9), 60, "a")
    store = canonical.elect_canonical(spark.createDataFrame(rows[:40], SCHEMA))
    log = canonical.insert_flips(store, spark.createDataFrame(rows[40:], SCHEMA))
    winners = store.where("is_canonical").count() + 20
    assert log.count() <= 2 * winners and len({r["fact_id"] for r in log.collect()}) == log.count()
