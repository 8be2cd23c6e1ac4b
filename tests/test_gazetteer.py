import random

from pyspark.sql import functions as F

from factloom.operators import extraction, gazetteer
from factloom.sources.vocabulary import Field, Vocabulary


def brute(texts, names):
    first = {}
    for name, place in names:
        if name:
            first[name] = min(place, first.get(name, place))
    return sorted((i, place, name) for i, t in texts for name, place in first.items() if t and name in t)


def random_case(rng):
    letters = "abcé市"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    names = [(word(rng.randrange(1, 5)), i) for i in range(60)] + [("", 900), (None, 901)]
    texts = [(i, word(rng.randrange(0, 40))) for i in range(80)] + [(80, None), (81, ""), (82, "ab"), (82, "ab")]
    return texts, names


def test_mentions_of_a_table_of_names(spark):
    texts, names = random_case(random.Random(1))
    df, table = spark.createDataFrame(texts, "id int, body string"), spark.createDataFrame(names, "name string, ord int")
    assert sorted(tuple(r) for r in gazetteer.mentioned(df, "id", "body", table).collect()) == brute(texts, names)


def test_blocks_of_names_change_nothing(spark):
    texts, names = random_case(random.Random(2))
    df, table = spark.createDataFrame(texts, "id int, body string"), spark.createDataFrame(names, "name string, ord int")
    assert sorted(tuple(r) for r in gazetteer.mentioned(df, "id", "body", table, block_bytes=300).collect()) == brute(texts, names)


def test_no_names_and_no_texts(spark):
    df, table = spark.createDataFrame([(1, "a")], "id int, body string"), spark.createDataFrame([], "name string, ord int")
    assert gazetteer.mentioned(df, "id", "body", table).collect() == []
    some = spark.createDataFrame([("a", 1)], "name string, ord int")
    assert gazetteer.mentioned(df.where("false"), "id", "body", some).collect() == []


def test_hundred_thousand_names_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    present = sorted({w for _, t in rows[:30] for w in (t or "").split() if len(w) > 3})[:300]
    names = [(f"name{i}", i) for i in range(100_000)] + [(w, 200_000 + i) for i, w in enumerate(present)]
    table = spark.createDataFrame(names, "name string, ord long")
    got = sorted((r["doc_id"], r["name"]) for r in gazetteer.mentioned(docs, "doc_id", "text", table).collect())
    assert got == sorted((i, w) for i, t in rows for w in present if t and w in t)


def test_vocabulary_of_any_size_gives_the_same(spark):
    """Table rows are searched by expressions below a number of names, by the automaton above it."""
    fields = (Field("GDP", "", "city"),)
    names = ("济南市", "青岛", "Lyon", "Ly", "Nice")
    few = Vocabulary(fields=fields, names=names, entity_required=())
    many = Vocabulary(fields=fields, names=names + tuple(f"none {i}" for i in range(100)), entity_required=())
    texts = [[None, "to Lyon", "Nice"], ["青岛 and 济南市"], [], None, ["", "x"], ["Ly"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, a array<string>")
    got = df.select("id", extraction.first_mention(F.col("a"), few).alias("few"), extraction.first_mention(F.col("a"), many).alias("many")).orderBy("id").collect()
    assert [(r["few"], r["many"]) for r in got] == [(x, x) for x in ("Lyon", "济南", None, None, None, "Ly")]
    body = spark.createDataFrame([("Nice 青岛 Lyon",), (None,), ("",)], "t string").select(extraction.mentions(F.col("t"), few).alias("m")).collect()
    assert [r["m"] for r in body] == [["青岛", "Lyon", "Ly", "Nice"], [], []]


def brute_spans(text, vocab):
    """Every alias at every place, unless a longer alias of another field stands within eight characters around it."""
    rows = [(alias.lower(), name, k) for k, (alias, _, name, _) in enumerate(vocab.alias_rows)]
    low, out = (text or "").lower(), []
    for at in range(len(low)):
        for alias, name, k in rows:
            if low.startswith(alias, at):
                near = low[max(0, at - 8):at + len(alias) + 8]
                if not any(o in near for o, other, _ in rows if len(o) > len(alias) and alias in o and other != name):
                    out.append((at, at + len(alias), k, name))
    return sorted(out)


def test_alias_spans_equal_the_definition(spark):
    vocab = Vocabulary(fields=(Field("GDP", "x", "city", ("gdp", "gross")), Field("per capita GDP", "y", "city", ("gdp per capita",)), Field("gross income", "", None, ("income", "oss")),
                               Field("甲方", "", None, ("甲",))))
    rng = random.Random(5)
    parts = ["GDP", "gdp per capita", "Gross income", "income", "gross", " ", "x", "per capita ", "İ", "甲方", "甲", "GDPGDP", ", "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(120)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: [(s["start"], s["end"], s["ord"], s["field"]) for s in r["s"]] for r in df.select("id", extraction.alias_spans(F.col("t"), vocab).alias("s")).collect()}
    for i, t in enumerate(texts):
        if "İ" not in (t or ""):  # its lower case is longer; places are checked below
            assert sorted(got[i]) == brute_spans(t, vocab)
    one = spark.createDataFrame([("İİ GDP",)], "t string").select(extraction.alias_spans(F.col("t"), vocab).alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in one] == [(3, 6)] * 2
