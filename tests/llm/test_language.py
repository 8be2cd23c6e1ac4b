import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language
from tests.llm import cases


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="module")
def filters(given):
    return language.train_filters(given.where(~language.held_out()))


def test_held_out_accuracy(given, filters):
    lang = {r["doc_id"]: r["lang"] for r in given.collect()}
    got = language.language_of(given).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_learning_ignores_held_out_rows(spark, given, filters):
    spoiled = given.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    again = language.train_filters(spoiled.where(~language.held_out()))
    assert again.languages == filters.languages and (again.masks == filters.masks).all()


def test_slots_hold_every_language_of_a_gram(spark):
    rows = spark.createDataFrame([(1, "abcdef abcdef", "aa"), (2, "abcdef uvwxyz", "bb"), (3, "uvwxyz", "cc")], "doc_id long, text string, lang string")
    made = language.train_filters(rows)
    assert made.languages == ["aa", "bb", "cc"]

    def holders(gram):
        mask = ~np.zeros(1, made.masks.dtype)
        for at in language.slots(language.gram_hashes(gram, len(gram))):
            mask &= made.masks[at]
        return {made.languages[p] for p in range(3) if mask[0] & (1 << p)}

    assert holders(b"abc") == {"aa", "bb"} and holders(b"uvwxy") == {"bb", "cc"} and holders(b"qqq") == set()
    assert language.identify("abcdef", made)[0] in ("aa", "bb") and language.identify("uvwxyz", made)[0] in ("bb", "cc")


def test_false_positives_are_taken_off():
    full = np.full(language.SLOTS, 2, np.uint8)  # the second filter is saturated and tells nothing
    full[:1000] |= 1
    for at in language.slots(language.gram_hashes(language.letters("hello"), 3)):
        full[at] |= 1
    made = language.LanguageFilters(["aa", "bb"], full, np.array([0.0, 1.0]))
    assert language.identify("hello hello", made)[0] == "aa"


def test_long_text_in_runs_equals_one_run(filters, monkeypatch):
    text = "the thing and der Zaun est là " * 500
    whole = language.identify(text, filters)
    monkeypatch.setattr(language, "RUN", 97)
    assert language.identify(text, filters) == whole


def test_odd_documents(spark, filters):
    docs = cases.documents(spark)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict_language(docs, filters).collect()}
    for n, text in enumerate(cases.ODD_TEXTS):
        unknown = not text or not any(map(str.isalpha, text))
        assert ((n, "und") in got) == unknown, text


def test_filter_empty_clashing_and_unlabelled(spark, given):
    kept = language.known_language(given)
    assert kept.columns == given.columns and kept.count() == given.where("text rlike '[a-zA-Z]'").count()
    assert language.language_of(cases.empty(spark)).collect() == []
    assert language.known_language(cases.empty(spark)).collect() == []
    rows = cases.clashing(spark)
    assert language.language_of(rows).count() == 3
    nothing = language.language_of(cases.documents(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def grams_of(text, width):
    """N-grams by definition, character by character."""
    import unicodedata
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    raw = (" " + " ".join(w for w in kept.split(" ") if w) + " ").encode()
    return [raw[i:i + width] for i in range(len(raw) - width + 1)] if len(raw) >= 3 else []


def brute_filters(rows):
    """Exact sets of n-grams per language under the same rules, on Python dictionaries."""
    counts = {}
    for _, text, lang in rows:
        for width in language.WIDTHS:
            for g in grams_of(text, width):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    frequency = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {}
    for f in frequency.values():
        for g, x in f.items():
            top[g] = max(x, top.get(g, 0))
    return {lang: {g for g, x in f.items() if x >= language.RATIO * top[g] and x >= language.LEAST} for lang, f in frequency.items()}


def brute_identify(text, filters):
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    hits = {lang: sum(g in own for width in language.WIDTHS for g in grams_of(text, width)) for lang, own in sorted(filters.items())}
    best = max(hits, key=lambda lang: hits[lang])
    return (best, hits[best] / sum(hits.values())) if any(hits.values()) else (next(iter(hits)), 1 / len(hits))


def test_filters_and_decisions_equal_sets(spark):
    rows = [(1, "Der Hund läuft — über «die» Straße, ÜBER alles", "de"), (2, "The dog runs over the street; above all else", "en"),
            (3, "Собака бежит по улице, над всем", "ru"), (4, "कुत्ता सड़क पर दौड़ता है", "hi"), (5, "犬は道を走る。犬は", "ja"), (6, "L’été – ÉTÉ\u00a0: le chien court", "fr")]
    made = language.train_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    exact = brute_filters(rows)
    planes = made.planes()[0]
    for p, name in enumerate(made.languages):
        held = {g for own in exact.values() for g in own
                if all(planes[at[0]] >> p & 1 for at in language.slots(language.gram_hashes(g, len(g))))}
        assert held == exact[name]  # so few n-grams collide in no slot
    for text in ["hund über straße", "the street", "собака", "सड़क पर", "道を走る", "été", "« ÉTÉ » — été", "123 !?", "", None, "zzz qqq", "ÜBER", "x" * 50]:
        want, score = brute_identify(text, exact)
        got = language.identify(text, made)
        assert got[0] == want and got[1] == pytest.approx(score, abs=1e-3)


@pytest.mark.parametrize("text,want", [
    ("« Été » — ÉTÉ", " été été "), ("a\u00a0b\u200bc1d", " a b c d "), ("日本語、テスト。", " 日本語 テスト "), ("e\u0301te", " e\u0301te "), ("İ", " i\u0307 "), ("—", "  "),
    ("".join(chr(c) for c in range(0x2000, 0x2070)) + "x", None)])
def test_letters_of_all_scripts(text, want):
    got = language.letters(text)
    assert got == want.encode() if want is not None else b" x " in got and chr(0x2026).encode() not in got


def test_more_languages_than_bits(spark):
    alphabet = "abcdefghijklmnop"
    word = lambda n: "".join(alphabet[(n >> 4 * k) % 16] * 2 for k in range(3)) + alphabet[n % 16] * 3
    rows = [(n, f"{word(n)} {word(n)}", f"l{n:03d}") for n in range(150)]
    made = language.train_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(made.languages) == 150 and made.planes().shape[0] == 3
    exact = brute_filters(rows)
    for n in (0, 1, 63, 64, 65, 127, 128, 149):
        assert language.identify(rows[n][1], made)[0] == brute_identify(rows[n][1], exact)[0]


def test_nothing_is_lost_without_labels(spark):
    docs = cases.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = language.known_language(docs)
    want = [r for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))]
    assert cases.table(kept) == sorted((tuple(r) for r in want), key=lambda r: [(v is not None, str(type(v)), v) for v in r])
    with pytest.raises(ValueError):
        language.known_language(docs, ("en",))


def test_only_wanted_languages(spark, given):
    kept = language.known_language(given, ("de",))
    told = {r["doc_id"]: r["lang_pred"] for r in language.language_of(given).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, lang in told.items() if lang == "de")
