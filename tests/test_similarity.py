import random
import re

import pytest

from factloom.operators import similarity
from factloom.operators.similarity import similar_names


def grams(name):
    s = re.sub(r"\.[^.]+$", "", name.lower())
    s = re.sub(r"[\s_\-—·()（）【】\[\]]+", "", s)
    return {s[i:i + 3] for i in range(len(s) - 2)} if len(s) >= 3 else {s} - {""}


def tokens(name):
    return [t for t in re.split(r"[\s_\-—·()（）【】\[\]0-9]+", re.sub(r"\.[^.]+$", "", name.lower())) if len(t) >= 2]


def brute(left, right, at_least):
    out = []
    for i, a in left:
        for j, b in right:
            if a is None or b is None:
                continue
            x, y = grams(a), grams(b)
            jaccard = len(x & y) / max(1, len(x | y))
            hits = sum(t in a.lower() for t in tokens(b))
            value = jaccard * 0.7 + min(1.0, hits / 3) * 0.3
            if (jaccard or hits) and value >= at_least - 1e-9:
                out.append((i, j, round(value, 9)))
    return sorted(out)


def names(rng, n):
    words = ["report", "city", "budget", "re", "2024", "gdp", "地区", "生产总值", "x", "port"]
    out = ["".join(rng.choice(words) + rng.choice(["", "_", " ", "-", ".xlsx"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    return [(i, t) for i, t in enumerate([*out, None, "", "a", "ab", "report", "REPORT.xlsx"])]


@pytest.mark.parametrize("at_least", [0.0, 0.2, 0.45, 0.7, 0.8, 1.0])
def test_pairs_equal_all_pairs(spark, at_least):
    rng = random.Random(int(at_least * 100))
    left, right = names(rng, 60), names(rng, 40)
    a, b = spark.createDataFrame(left, "a int, name string"), spark.createDataFrame(right, "b int, name string")
    got = sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in similar_names(a, "a", "name", b, "b", "name", at_least).collect())
    assert got == brute(left, right, at_least)


def test_empty_sides(spark):
    a, b = spark.createDataFrame([(1, "report")], "a int, name string"), spark.createDataFrame([], "b int, name string")
    assert similar_names(a, "a", "name", b, "b", "name").collect() == []
    assert similar_names(b, "b", "name", a, "a", "name", 0.5).collect() == []


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_equal_names_are_compared_once_and_all_their_ids_come_back(spark, monkeypatch, tmp_path, most):
    """Also where no side may be broadcast: then none is, whatever Spark takes the size of its file for."""
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", most)
    stored = {}
    monkeypatch.setattr(similarity, "materialised", lambda df, what: stored.setdefault(what, df.localCheckpoint()))
    left = [(i, n) for i, n in enumerate(["city report", "gdp budget", "city report.xlsx", None] * 25)]
    right = [(i, n) for i, n in enumerate(["report city", "budget"] * 3)]
    a, b = spark.createDataFrame(left, "a int, name string"), spark.createDataFrame(right, "b int, name string")
    out = similar_names(a, "a", "name", b, "b", "name", 0.2)
    assert sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in out.collect()) == brute(left, right, 0.2)
    assert stored["left-names"].count() == 3 and stored["right-names"].count() == 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (most > 0)
