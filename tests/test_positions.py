"""Positions of facts, and prose whose aliases overlap."""

from pyspark.sql import functions as F

from factloom.operators import filling, transform
from factloom.operators.extraction import extract_facts, extract_text_facts, running_positions
from factloom.sources.blocks import markdown_blocks, text_blocks
from factloom.sources.vocabulary import Field, Vocabulary

VOCAB = Vocabulary(fields=(Field("GDP总量", "亿元", "city", ("gdp",)), Field("常住人口", "万", "city", ("人口",))), names=("济南", "青岛", "上海"))


def facts(spark):
    rows = [("b", "|城市|GDP总量（亿元）|常住人口（万）|\n|-|-|-|\n|青岛|7|1|\n|济南|8|2|"), ("a", "|城市|常住人口（万）|\n|-|-|\n|上海|3|\n|青岛|4|")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("file_name", F.col("doc_id"))
    return extract_facts(markdown_blocks(docs, keep=("file_name",)), VOCAB)


def test_first_appearance_over_documents(spark):
    found = running_positions(facts(spark), partitions=3)
    assert sorted(r["pos"] for r in found.collect()) == list(range(6))
    by_pos = [r["entity_name"] for r in transform.unique_entities(found).orderBy("first_pos").collect()]
    assert by_pos == ["上海", "青岛", "济南"]
    order = spark.createDataFrame([("b", 0), ("a", 1)], "doc_id string, doc_pos long")
    found = running_positions(facts(spark), order)
    assert [r["entity_name"] for r in transform.unique_entities(found).orderBy("first_pos").collect()] == ["青岛", "济南", "上海"]
    wide = {r["entity"]: r["常住人口"] for r in transform.entity_pivot(found, ["常住人口"]).collect()}
    assert wide == {"青岛": "4.0", "济南": "2.0", "上海": "3.0"}


def test_rows_are_filled_in_the_order_of_the_documents(spark):
    found = running_positions(facts(spark))
    entities = transform.unique_entities(found).select(
        F.lit("t").alias("template"), F.lit("s").alias("sheet"), F.col("entity_name").alias("entity"), F.col("first_pos").alias("pos"))
    placed = filling.rank_by_position(entities, "pos", filling.SHEET, "k").orderBy("k").collect()
    assert [(r["entity"], r["k"]) for r in placed] == [("上海", 1), ("青岛", 2), ("济南", 3)]


def prose(spark, text, vocab):
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string").withColumn("file_name", F.lit("d.txt"))
    return [(r["field_name"], r["value_num"]) for r in extract_text_facts(text_blocks(docs, keep=("file_name",)), vocab).orderBy("pos").collect()]


def vocabulary(*fields):
    return Vocabulary(fields=tuple(Field(n, u, None, a) for n, u, a in fields))


def test_an_alias_without_a_value_keeps_no_other_off(spark):
    vocab = vocabulary(("x", "万人", ("AAB",)), ("y", "亿元", ("BC",)))
    assert prose(spark, "AABC 5亿元", vocab) == [("y", 5.0)]
    assert prose(spark, "AABC 5万人", vocab) == [("x", 5.0)]


def test_longest_alias_wins_where_both_have_values(spark):
    vocab = vocabulary(("short", None, ("税",)), ("long", None, ("税收收入",)))
    assert prose(spark, "税收收入 12 元", vocab) == [("long", 12.0)]
    assert prose(spark, "税 3 元，税收收入 12 元", vocab)[0] == ("long", 12.0)
    same_start = vocabulary(("money", "亿元", ("GDP总量",)), ("people", "万人", ("GDP",)))
    # The longer alias has no compatible number, and hides the shorter one of the other field all the same.
    assert prose(spark, "GDP总量 5万人", same_start) == []
    assert prose(spark, "gdp 5万人", same_start) == [("people", 5.0)]


def test_repeated_and_adjacent_aliases(spark):
    vocab = vocabulary(("z", None, ("aa",)),)
    assert prose(spark, "aaa 7", vocab) == [("z", 7.0)]
    assert prose(spark, "aa 1 AA 2 aA 3", vocab) == [("z", 1.0), ("z", 2.0), ("z", 3.0)]
    assert prose(spark, "nothing here 5", vocab) == []
    assert prose(spark, "nothing here 5", Vocabulary()) == []
