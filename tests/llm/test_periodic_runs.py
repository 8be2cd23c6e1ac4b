import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from factloom.llm import periodic_runs as pr
from tests.llm import cases


def brute_runs(words):
    """Runs by definition: for each period the maximal stretches of equal words that far apart, kept where no smaller period does."""
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            stop = at
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            if stop + q - at >= max(24, 3 * q):
                seen.setdefault((at, stop + q), q)
            at = stop + 1
    return sorted((b, e - b, q) for (b, e), q in seen.items())


def random_words(rng):
    """Texts of few words, with planted repetitions of all kinds, nested ones too."""
    alphabet = [b"a", b"b", b"c", b"d", b"e", b"f"][:rng.randrange(1, 7)]
    out = [rng.choice(alphabet) for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(0, 5)):
        root = [rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 50]))]
        if rng.random() < 0.3:
            root = (root[:3] * 20)[:len(root)] + root[:1]
        out += (root * 12)[:rng.randrange(len(root), 7 * len(root) + 30)]
        out += [rng.choice(alphabet) for _ in range(rng.randrange(0, 20))]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_the_definition(seed):
    rng = random.Random(seed)
    documents = [random_words(rng) for _ in range(12)]
    documents += [documents[0], documents[3][:30], []]
    assert [list(r) for r in pr.document_runs(documents)] == [brute_runs(d) for d in documents]


@pytest.mark.parametrize("period", [*range(1, 20), 24, 31, 32, 33, 63, 64, 65, 100])
def test_each_period_at_its_least_length(period):
    root = [b"%d" % i for i in range(period)]
    for length in (max(24, 3 * period) - 1, max(24, 3 * period), max(24, 3 * period) + 5):
        for offset in (0, 1, 5, 8, 13):
            words = [b"x%d" % i for i in range(offset)] + (root * (length // period + 1))[:length] + [b"y"]
            expected = [(offset, length, period)] if length >= max(24, 3 * period) else []
            assert list(pr.document_runs([words])) == [expected]


def test_fibonacci_words_and_one_word():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(12):
        a, b = b, b + a
    assert list(pr.document_runs([b, [b"w"] * 5000])) == [brute_runs(b), [(0, 5000, 1)]]


@pytest.mark.parametrize("seed", range(5))
def test_wavelet_tree(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    values = rng.permutation(n)
    tree = pr.WaveletTree(values, max(1, (n - 1).bit_length()))
    left = rng.integers(0, n, 200)
    right = np.array([rng.integers(x, n) + 1 for x in left])
    limit = rng.integers(0, n + 3, 200)
    assert tree.below(left, right, limit).tolist() == [int((values[x:y] < z).sum()) for x, y, z in zip(left, right, limit)]
    k = np.array([rng.integers(0, y - x) for x, y in zip(left, right)])
    assert tree.smallest(left, right, k).tolist() == [int(np.sort(values[x:y])[z]) for x, y, z in zip(left, right, k)]


def test_repetition_of_ids():
    words = [b"%d" % i for i in range(50)]
    for doc_id in range(200):
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, 50
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        expected = [words[i] if h % 10 or i < a else words[a + (i - a) % p] for i in range(n)]
        assert pr.repeated_words(words, doc_id) == expected
    assert pr.repeated_words(words, None) == words and pr.repeated_words([], 3) == []


def digest(words):
    found = brute_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *head, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def expected_rows(rows):
    return sorted(((d, *digest(pr.repeated_words((t or "").encode().split(), d))) for d, t in rows), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 8000]
    got = sorted((tuple(r) for r in pr.run_digests(docs).collect()), key=str)
    assert len(got) == len(rows) and any(r[1] for r in got)
    ids = {d for d, _ in short}
    assert [r for r in got if r[0] in ids] == expected_rows(short)


def test_odd_documents_and_tables(spark):
    docs = cases.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in pr.run_digests(docs).collect()), key=str) == expected_rows(rows)
    assert pr.run_digests(cases.empty(spark)).collect() == []
    assert pr.run_digests(cases.clashing(spark)).count() == 3
    assert [tuple(r) for r in pr.periodic_runs(docs).collect() if r["length"] == 3000] == [(21, 0, 3000, 1)]


def test_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    documents = [random_words(rng) for _ in range(30)]
    whole = [f for _, f in pr._searched(iter(documents))]
    monkeypatch.setattr(pr, "CHUNK", 50)
    assert [f for _, f in pr._searched(iter(documents))] == whole
