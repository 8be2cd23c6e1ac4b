from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from factloom.operators import canonical, extraction, selection
from factloom.operators.filling import as_cells, data_rows, detect_layout, fact_lookup, fill_mixed, look_up
from factloom.schemas import FACT
from factloom.sources.blocks import markdown_blocks, text_blocks
from factloom.sources.vocabulary import Field, Vocabulary

VOCAB = Vocabulary(
    fields=(
        Field("GDP总量", "亿元", "city", ("gdp总量", "gdp", "地区生产总值")), Field("常住人口", "万人", "city", ("人口数",)),
        Field("人均GDP", "元", "city", ("人均gdp",)), Field("工业增加值", "亿元", "city"),
        Field("第二产业增加值", "亿元", "city", ("工业增加值",)), Field("城镇化率", "%", "city"),
        Field("甲方", None, "contract", ("采购方",)), Field("签订日期", None, "contract"), Field("医院数", "个", "national"),
    ),
    names=("北京", "上海", "济南", "青岛", "全国"),
)


def docs(spark, *texts, name="资料2023年.txt"):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    return df.withColumn("file_name", F.lit(name))


def prose(spark, *texts, **kw):
    b = text_blocks(docs(spark, *texts, **kw), keep=("file_name",))
    f = extraction.extract_text_facts(b, VOCAB)
    return {(r["entity_name"], r["field_name"]): r for r in f.collect()}


def test_prose_facts(spark):
    got = prose(spark, "2024年济南市 GDP 总量达到 1.2万亿元，常住人口943万。青岛人均 GDP为15.5万元")
    gdp = got["济南", "GDP总量"]
    assert (gdp["value_num"], gdp["unit"], gdp["year"], gdp["confidence"], gdp["status"]) == (12000.0, "亿元", 2024, 0.88, "confirmed")
    assert (got["济南", "常住人口"]["value_num"], got["济南", "常住人口"]["unit"]) == (943.0, "万人")
    assert (got["青岛", "人均GDP"]["value_num"], got["青岛", "人均GDP"]["unit"]) == (155000.0, "元")
    assert len(got) == 3  # the GDP inside 人均GDP is no fact of its own


def test_number_before_the_alias_and_years(spark):
    got = prose(spark, "上海以 56,708.71亿元的GDP总量居首")
    assert got["上海", "GDP总量"]["value_num"] == 56708.71
    # the number ahead is in %, so the search goes back, skipping a bare year
    got = prose(spark, "北京3.5万亿元，在2023的GDP总量增长5%")
    assert got["北京", "GDP总量"]["value_num"] == 35000.0


def test_city_field_needs_an_entity_and_others_fall_back_to_the_file(spark):
    got = prose(spark, "GDP总量 100亿元。医院数 30 个")
    assert list(got) == [("资料2023年.txt", "医院数")]
    r = got["资料2023年.txt", "医院数"]
    assert (r["confidence"], r["status"], r["year"]) == (0.72, "pending_review", 2023)


def test_contract_values(spark):
    got = prose(spark, "甲方：某某公司，签订日期 2024-03-05。甲方 无")
    f = {k[1]: v["value_text"] for k, v in got.items()}
    assert f == {"甲方": "某某公司", "签订日期": "2024-03-05"}


def test_alias_collision(spark):
    assert VOCAB.header_lookup["工业增加值"] == "第二产业增加值"  # headers: the later field
    assert ("济南", "工业增加值") in prose(spark, "济南工业增加值 10亿元")  # prose: the earlier one


def table(spark, md):
    b = markdown_blocks(docs(spark, md), keep=("file_name",))
    return {(r["entity_name"], r["field_name"]): r for r in extraction.dedupe_facts(extraction.extract_table_facts(b, VOCAB)).collect()}


def test_table_facts(spark):
    got = table(spark, "|城市|日期|GDP总量（亿元）|常住人口|备注|\n|-|-|-|-|-|\n|济南市|2024/1/5|12,000|943万人|好|\n| |45000|3万亿元| |见青岛市|")
    a = got["济南", "GDP总量"]
    assert (a["value_num"], a["unit"], a["metadata"], a["confidence"]) == (12000.0, "亿元", {"date": "2024-01-05"}, 0.95)
    assert (got["济南", "备注"]["value_num"], got["济南", "备注"]["entity_type"]) == (None, "generic")
    b = got["青岛", "GDP总量"]  # entity found in an unknown column, day number as date
    assert (b["value_num"], b["unit"], b["metadata"]) == (30000.0, "亿元", {"date": "2023-03-15"})


def test_table_without_entity(spark):
    got = table(spark, "|序号|GDP总量|医院数|\n|-|-|-|\n|1|5|7|")
    assert set(got) == {("资料2023年.txt", "序号"), ("资料2023年.txt", "医院数")}
    assert got["资料2023年.txt", "医院数"]["confidence"] == 0.86


def random_facts(spark, n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        entity = "hot" if i % 3 == 0 else rnd.choice("abcd")  # a third of all rows in one group
        rows.append((f"f{i:05d}", "city", entity, rnd.choice(["x", "y"]), rnd.choice([None, 1.0, 2.0]), "t",
                     rnd.choice([None, "元"]), rnd.choice([None, 2020]), rnd.choice("pq"), f"b{i}", "s",
                     rnd.choice([0.7, 0.9]), rnd.choice(["confirmed", "rejected"]), {}, i))
    return spark.createDataFrame(rows, FACT)


def expected_winners(rows):
    best = {}
    for r in rows:
        if r["status"] == "rejected":
            continue
        key = (r["entity_type"], r["entity_name"], r["field_name"], r["year"], r["unit"])
        rank = (r["confidence"], r["value_num"] is not None, r["source_doc_id"], r["fact_id"])
        if key not in best or rank > best[key]:
            best[key] = rank
    return {rank[3] for rank in best.values()}


def winners(df):
    return {r["fact_id"] for r in df.where("is_canonical").collect()}


def test_election(spark):
    facts = random_facts(spark, 900, 1)
    elected = canonical.elect_canonical(facts)
    assert elected.count() == 900
    assert winners(elected) == expected_winners(facts.collect())
    groups = elected.where("is_canonical").groupBy("conflict_group_id").count()
    assert groups.where("count > 1").count() == 0


def test_incremental_equals_full(spark):
    facts = random_facts(spark, 600, 2)
    early, late = facts.where("pos < 400"), facts.where("pos >= 400")
    step = canonical.elect_affected(canonical.elect_canonical(early), late)
    assert step.count() == 600
    assert winners(step) == winners(canonical.elect_canonical(facts))


def test_partial_elections_merge(spark):
    facts = random_facts(spark, 600, 3)
    parts = [canonical.group_winners(facts.where(f"pos % 3 = {k}")) for k in range(3)]
    merged = canonical.merge_winners(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert {r["fact_id"] for r in merged.collect()} == winners(canonical.elect_canonical(facts))


def test_dedupe_is_idempotent(spark):
    facts = random_facts(spark, 300, 4).withColumn("source_block_id", F.lit("b"))
    once = extraction.dedupe_facts(facts)
    assert once.count() == extraction.dedupe_facts(once).count() == facts.select("entity_name", "field_name").distinct().count()


def test_review_rejects_and_reelects(spark):
    facts = canonical.elect_canonical(random_facts(spark, 200, 5))
    target = sorted(winners(facts))[0]
    reviews = spark.createDataFrame(
        [(target, "confirmed", "ann", None, "1"), (target, "rejected", "bob", " no ", "2")],
        "fact_id string, status string, reviewer string, note string, reviewed_at string")
    out = canonical.apply_reviews(facts, reviews)
    row = out.where(F.col("fact_id") == target).first()
    assert row["status"] == "rejected" and not row["is_canonical"]
    assert row["metadata"] == {"reviewed_at": "2", "reviewer": "bob", "review_note": "no"}
    assert winners(out) == expected_winners(out.collect())


def test_intent_filter(spark):
    rows = [("a", "济南高新区", 2021, None), ("b", "济南市", 2019, None), ("c", "青岛市", 2021, None), ("d", None, None, None),
            ("e", "济南", 2010, "2021-05-01"), ("f", "济南", 2021, "2020-01-01")]
    df = spark.createDataFrame(rows, "fact_id string, entity_name string, year int, d string").withColumn(
        "metadata", F.when(F.col("d").isNotNull(), F.create_map(F.lit("date"), F.col("d"))).otherwise(F.create_map().cast("map<string,string>")))
    got = {r["fact_id"] for r in selection.intent_filter(df, "2021-01-01", "2021-12-31", ["济南"]).collect()}
    assert got == {"a", "d", "e"}


def test_nearest_hour_keeps_input_without_the_date(spark):
    df = spark.createDataFrame([(1, "2025-11-25 08:00"), (2, "2025-11-25 11:30"), (3, "2025-11-25"), (4, None)], "i int, t string")
    ids = lambda d, h: {r["i"] for r in selection.nearest_hour(df, "t", d, h).collect()}
    assert ids("2025-11-25", 9) == {1}
    assert ids("2025-11-25", None) == {1, 2, 3}
    assert ids("2024-01-01", 9) == {1, 2, 3, 4}


def test_hook_checks_rows(spark):
    b = text_blocks(docs(spark, "济南 GDP 共 3万亿元"), keep=("file_name",))

    def hook(chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, k in zip(chunks["doc_id"], chunks["block_id"]):
            out += [(d, k, "济南市", "地区生产总值", "3万亿元", None, "e"), (d, k, "", "GDP总量", "1", None, None), (d, k, "济南", "other", "1", None, None)]
        return pd.DataFrame(out, columns=["doc_id", "block_id", "entity_name", "field_name", "value", "unit", "evidence"])

    got = extraction.run_extractor(b, hook, VOCAB, "intent", ["GDP总量", "地区生产总值"]).collect()
    assert [(r["entity_name"], r["field_name"], r["value_num"], r["unit"], r["confidence"]) for r in got] == [("济南", "GDP总量", 30000.0, "亿元", 0.92)]


def test_fallback_only_for_documents_without_facts(spark):
    b = text_blocks(docs(spark, "济南 GDP总量 3亿元", "空白"), keep=("file_name",))

    def hook(chunks: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(d, k, "x", "y", "1", None, None) for d, k in zip(chunks["doc_id"], chunks["block_id"])],
                            columns=["doc_id", "block_id", "entity_name", "field_name", "value", "unit", "evidence"])

    got = {(r["source_doc_id"], r["confidence"]) for r in extraction.extract_with_fallback(b, VOCAB, hook).collect()}
    assert got == {("0", 0.88), ("1", 0.75)}


def test_lookup_answers_to_both_names(spark):
    facts = random_facts(spark, 1, 6).withColumn("entity_name", F.lit("济南"))
    cells = spark.createDataFrame([("济南市", "x"), ("济南", "x"), ("济南市", "y"), ("济南", "y")], "e string, field string")
    assert look_up(cells, fact_lookup(facts), "e").count() == 2


def test_mixed_fill(spark):
    cells = [(1, 1, "城市"), (1, 2, "GDP总量(亿元)"), (2, 1, "济南市"), (3, 1, ""), (4, 1, ""), (5, 1, "上海")]
    df = spark.createDataFrame([("t", "s", *c) for c in cells], "template string, sheet string, row int, col int, value string")
    plan, columns = detect_layout(df, VOCAB)
    assert [tuple(r) for r in columns.collect()] == [("t", "s", 2, "GDP总量")]
    ents = spark.createDataFrame([("t", "s", e, i) for i, e in enumerate(["青岛", "济南", "北京"])], "template string, sheet string, entity string, pos long")
    facts = spark.createDataFrame(
        [(f"f{i}", "city", e, "GDP总量", v, "t", "亿元", None, "d", f"b{i}", "s", 0.9, "confirmed", {}, i)
         for i, (e, v) in enumerate([("青岛", 1.0), ("济南", 2.5), ("北京", 3.0)])], FACT)
    out = as_cells(fill_mixed(data_rows(df, plan), plan, columns, ents, fact_lookup(facts)), "task")
    got = {(r["cell_ref"], r["entity_name"], r["value_num"]) for r in out.collect()}
    # blanks take 青岛 and then 济南 although it has a row already; 北京 is appended
    assert got == {("B2", "济南", 2.5), ("B3", "青岛", 1.0), ("B4", "济南", 2.5), ("B6", "北京", 3.0)}


def test_vocabulary_from_tables(spark):
    aliases = spark.createDataFrame([("gdp", "GDP"), ("output", "GDP"), ("people", "population")], "alias string, field string")
    fields = spark.createDataFrame([("population", "万人", "city", 2), ("GDP", "亿元", "city", 1)], "field string, unit string, entity_type string, ord int")
    names = spark.createDataFrame([("B", 2), ("A", 1)], "name string, ord int")
    v = Vocabulary.from_tables(aliases, fields, names)
    assert [f.name for f in v.fields] == ["GDP", "population"]
    assert v.names == ("A", "B")
    assert v.header_lookup["people"] == "population" and v.header_lookup["output"] == "GDP"


def test_documents_are_listed_newest_first(spark):
    rows = [("a", "parsed", "x.txt", 1), ("b", "parsed", "X2.txt", 3), ("c", "failed", "x.txt", 9), ("d", "parsed", "y.txt", 5), ("e", "parsed", "ax.txt", 3)]
    docs = spark.createDataFrame(rows, "doc_id string, status string, file_name string, upload_time int")
    found = selection.list_documents(docs, "parsed", "X", "upload_time")
    assert [r["doc_id"] for r in found.collect()] == ["d", "b", "e", "a"]
