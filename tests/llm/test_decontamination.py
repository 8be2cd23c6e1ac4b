import random

import numpy as np
import pytest

from factloom.llm import decontamination as d
from factloom.llm.shared import words
from tests.llm import cases

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
ITEMS = "item_id long, text string"


def naive_tiles(doc, item, least):
    """Textbook greedy string tiling: the longest unmarked match first, by trying every pair of places."""
    used_doc, used_item, covered = [x < 0 for x in doc], [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not used_doc[i + n] and not used_item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        for k in range(n):
            used_doc[i + k] = used_item[j + k] = True
        covered += n


@pytest.mark.parametrize("seed", range(30))
def test_tiles_equal_the_textbook(seed):
    rng = random.Random(seed)
    letters = rng.choice([2, 4, 30])
    item = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
    doc = [rng.randrange(-1, letters) for _ in range(rng.randrange(1, 60))] + item[rng.randrange(len(item)):] + item[:rng.randrange(len(item))]
    for least in (1, 3, 5):
        got = d.tiles(np.array(doc), np.array(item), least)
        taken_doc, taken_item = set(), set()
        for at, place, n in got:
            assert doc[at:at + n] == item[place:place + n] and n >= least
            assert not taken_doc & set(range(at, at + n)) and not taken_item & set(range(place, place + n))
            taken_doc |= set(range(at, at + n))
            taken_item |= set(range(place, place + n))
        longest_first = [n for *_, n in got]
        assert longest_first == sorted(longest_first, reverse=True) or letters < 30
        if letters == 30:
            assert sum(longest_first) == naive_tiles(doc, item, least)


def found(spark, docs, items, **how):
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), **how)
    return {(r["doc_id"], r["item_id"]): round(r["coverage"], 2) for r in got.collect()}


def test_whole_reordered_and_partial_passages(spark):
    words_of = ITEM.split()
    docs = [(1, f"before, {ITEM.upper()}; after"), (2, " ".join(words_of[8:]) + " xx yy " + " ".join(words_of[:8])),
            (3, " ".join(words_of[:11])), (4, " ".join(reversed(words_of))), (5, " ".join(f"{w} zz" for w in words_of)), (6, None), (7, ""),
            (8, "filler " * 30_000 + ITEM), (9, " ".join(words_of[:13]))]
    assert found(spark, docs, [(10, ITEM), (11, None), (12, ""), (13, "no letters ???? in here at all")]) == {
        (1, 10): 1.0, (2, 10): 1.0, (8, 10): 1.0, (9, 10): 0.87}


def test_words_of_all_scripts():
    assert words("«L’été»\u00a0— “naïve”…x_y 3½") == [w.encode() for w in ("l", "été", "naïve", "x", "y", "3½")]
    assert words("東京は、ABC大") == [w.encode() for w in ("東", "京", "は", "abc", "大")]
    assert words("नमस्ते दुनिया") == [w.encode() for w in ("नमस्ते", "दुनिया")] and len(words("ภาษา")) == 4


def test_items_of_other_scripts_and_punctuation(spark):
    chinese, french = "水在标准大气压下的沸点是多少摄氏度？", "la capitale de la France est une grande ville"
    docs = [(1, f"昨天老师问我们：「{chinese}」没有人回答。"), (2, "今天天气很好，我们去公园散步。"), (3, f"Il dit «{french.replace(' ', chr(160))}»—puis rien")]
    assert found(spark, docs, [(10, chinese), (11, french)]) == {(1, 10): 1.0, (3, 11): 1.0}


def test_short_items_repeated_items_and_filters(spark):
    docs = [(1, "one two three"), (2, "one two four"), (1, "one two three"), (None, "x one two three")]
    items = [(1, "two three"), (2, "Two. Three!"), (3, "three two")]
    for bits in (1 << 6, 1 << 10, 1 << 27):
        got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), filter_bits=bits)
        assert sorted(((r["doc_id"] or 0, r["item_id"]) for r in got.collect())) == sorted([(1, 1), (1, 2), (1, 1), (1, 2), (0, 1), (0, 2)])


def test_filter_holds_every_seed():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 64, 5000, np.uint64)
    for bits in (6, 10, 20):
        f = d.SeedFilter(np.zeros(1 << (bits - 6), np.uint64))
        for slot in d.SeedFilter.slots(hashes, f.shift):
            np.bitwise_or.at(f.bits, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
        assert f.may_hold(hashes).size == hashes.size
    assert f.may_hold(rng.integers(0, 1 << 64, 100_000, np.uint64)).size < 1000


@pytest.mark.parametrize("bits", [1 << 8, 1 << 27])
def test_items_with_a_common_stem_equal_brute_force(spark, bits):
    rng = random.Random(7)
    stem, letters = "which of the following statements about the topic is true".split(), [f"w{n}" for n in range(12)]
    items = [(n, stem + rng.choices(letters, k=rng.randrange(0, 30))) for n in range(60)]
    docs = []
    for n in range(150):
        _, own = rng.choice(items)
        cut = rng.randrange(len(own))
        whole = rng.choice([own, own[cut:] + ["zz"] + own[:cut], own[:-1 - len(own) // 8], own[cut:], stem, rng.choices(letters, k=40) + own])
        docs.append((n, rng.choices(letters, k=rng.randrange(20)) + whole + rng.choices(letters, k=3)))
    want = set()
    for doc, read in docs:
        for item, own in items:
            ids = {w: k for k, w in enumerate(dict.fromkeys(own))}
            tiles = d.tiles(np.array([ids.get(w, -1) for w in read]), np.array([ids[w] for w in own]), 5)
            if sum(n for *_, n in tiles) >= 0.8 * len(own):
                want.add((doc, item, round(sum(n for *_, n in tiles) / len(own), 2)))
    got = found(spark, [(n, " ".join(w)) for n, w in docs], [(n, " ".join(w)) for n, w in items], filter_bits=bits)
    assert {(*k, v) for k, v in got.items()} == want and len(want) > 50


def test_against_brute_force_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).collect()}
    want = set()
    of_item = [(i, words(t)) for i, t in items.collect()]
    for doc, text in docs.select("doc_id", "text").collect():
        read = words(text or "")
        grams = {tuple(read[i:i + 5]) for i in range(len(read) - 4)}
        for item, own in of_item:
            # Upper bound by shared five-word runs first, the textbook tiling where it leaves the question open.
            seen = set()
            for i in range(len(own) - 4):
                if tuple(own[i:i + 5]) in grams:
                    seen |= set(range(i, i + 5))
            if len(seen) >= 0.8 * len(own):
                ids = {w: n for n, w in enumerate(dict.fromkeys(own))}
                known = [ids.get(w, -1) for w in read]
                if naive_tiles(known, [ids[w] for w in own], 5) >= 0.8 * len(own):
                    want.add((doc, item))
    assert got == want and got
    left = {r["doc_id"] for r in d.decontaminate(docs, items).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {doc for doc, _ in got}


def test_odd_empty_and_clashing(spark):
    items = spark.createDataFrame([(1, ITEM), (None, "one two three four")], ITEMS)
    docs = cases.documents(spark)
    assert d.contaminated(docs, items).collect() == []
    assert d.decontaminate(docs, items).count() == docs.count()
    assert d.contaminated(cases.empty(spark), items).collect() == []
    assert d.contaminated(docs, cases.empty(spark, ITEMS)).collect() == []
    assert d.decontaminate(docs, cases.empty(spark, ITEMS)).count() == docs.count()
    rows = cases.clashing(spark)
    left = d.decontaminate(rows, items)
    assert left.columns == rows.columns and [r["doc_id"] for r in left.collect()] == [3]


def test_remembered_words_are_bounded(monkeypatch):
    """A worker lives on through all stages, so what it remembers has a bound; hashes do not depend on it."""
    assert d.WordHashes.MOST <= 1 << 17
    monkeypatch.setattr(d.WordHashes, "MOST", 3)
    few = d.WordHashes()
    assert [few[b"%d" % i] for i in [*range(9), *range(9)]] == [d.xxhash.xxh3_64_intdigest(b"%d" % i) for i in [*range(9), *range(9)]]
    assert len(few) <= 3
