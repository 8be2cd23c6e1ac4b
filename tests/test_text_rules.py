"""Text, number and date rules on Chinese inputs; expected values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, numbers, text


@pytest.mark.parametrize("raw, want", [
    ("GDP总量（亿元）", "GDP总量"), ("常住 人口(万人", "常住人口"), (" 城　市 ", "城市"), ("a(b)c（d", "ac"), (None, ""),
])
def test_normalize_header(one, raw, want):
    assert one(raw, text.normalize_header) == want


@pytest.mark.parametrize("raw, want", [
    ("济南市", "济南"), ("山东省", "山东"), ("津市", "津市"), ("海南省市", "海南"), ("青 岛-市：", "青岛"), ("市", "市"),
])
def test_normalize_entity(one, raw, want):
    assert one(raw, text.normalize_entity) == want


@pytest.mark.parametrize("raw, want", [
    ("深圳市以 2.6 万亿元领跑", "深圳市"), ("上海凭借优势", "上海"), ("呼和浩特市新城区域", "呼和浩特市新"), ("Paris", "Paris"),
    ("A市场", "A市场"), ("  ", ""),
])
def test_clean_entity_value(one, raw, want):
    assert one(raw, text.clean_entity_value) == want


def test_header_kinds(one):
    assert one("城市（名）", text.is_entity_header)
    assert one(" Country / Region ", text.is_entity_header)
    assert not one("序号", text.is_date_header)
    assert one("序号", lambda c: text.is_date_header(c, row_numbers=True))


@pytest.mark.parametrize("raw, want", [
    ("约 12,345.6万亿元", (12345.6, "万亿元")), ("1，234 人", (1234.0, "人")), ("-5%", (-5.0, "%")), ("5775万", (5775.0, None)),
    ("无", (None, None)), ("１２３亿元", (123.0, "亿元")),
])
def test_number_unit(one, raw, want):
    assert one(raw, numbers.number_unit) == want


def test_prose_units_know_wan(one):
    from factloom.functions.fixed_values import PROSE_UNITS

    assert one("5775万", lambda c: numbers.number_unit(c, PROSE_UNITS)) == (5775.0, "万")


@pytest.mark.parametrize("raw, kw, target, alts, want", [
    ("GDP 总量达到 52,073.40 亿元", "GDP ?总量", "亿元", (), 52073.4),
    ("238,320 元的惊人人均 GDP", "人均 ?GDP", "元", (), 238320.0),
    ("常住人口 1.26 亿", "常住人口", "万", ("亿",), 12600.0),
    ("常住人口5775 万人", "常住人口", "", (), 5775.0),
    ("常住人口5775万人", "常住人口", "", (), None),
    ("没有数字", "常住人口", "万", (), None),
])
def test_find_num(one, raw, kw, target, alts, want):
    got = one(raw, lambda c: numbers.find_num(c, kw, target, alts))
    assert got is None if want is None else abs(got - want) < 1e-9


@pytest.mark.parametrize("v, want", [(3.0, "3"), (3.14, "3.14"), (2.5000, "2.5"), (-0.25, "-0.25"), (1e12, "1000000000000")])
def test_format_value(spark, v, want):
    df = spark.createDataFrame([(v,)], "v double")
    assert df.select(numbers.format_value("v")).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("2025/1/5", "2025-01-05"), ("于 2024-11-25 09:00:00.0", "2024-11-25"), ("45000", "2023-03-15"), ("1", "1899-12-31"),
    ("0.5", None), ("200001", None), ("2024年1月5日", None), ("", None), ("abc", None),
])
def test_parse_date(one, raw, want):
    assert one(raw, dates.parse_date) == want


@pytest.mark.parametrize("raw, want", [
    ("2025-11-25 09:00:00.0", "2025-11-25"), ("2020年7月1日", "2020-07-01"), ("2020/7", "2020-07-01"), ("2020", "2020-01-01"),
    ("44013", "2020-07-01"), ("not a date", None), ("2020-x-1", None), ("", None),
])
def test_row_date(one, raw, want):
    assert one(raw, dates.row_date) == want


def test_ranges(one):
    assert one("从 2020/7/1 到 2020-8-31", dates.date_range) == ("2020-07-01", "2020-08-31")
    assert one("仅 2020/7/1", dates.date_range) == ("2020-07-01", "2020-07-01")
    assert one("无", dates.date_range) == (None, None)
    assert one("2018至2023", dates.year_range) == (2018, 2023)
    assert one("2021年和2019年", dates.year_range) == (2019, 2021)
    assert one("2024年", dates.date_constraint) == ("2024-01-01", "2024-12-31")
    assert one("2019年底前约1999年", dates.infer_year) == 2019


@pytest.mark.parametrize("raw, want", [
    ("城市：济南市、青岛市、烟台市", ["济南", "青岛", "烟台"]), ("筛选：济南, 青岛", ["济南", "青岛"]), ("地区：潍坊/德州/聊城", ["潍坊", "德州", "聊城"]),
    ("城市：德州市\n城市：潍坊市", ["德州", "潍坊"]), ("没有", []),
])
def test_entity_list(one, raw, want):
    assert one(raw, dates.entity_list) == want


def test_table_context(one):
    names = ["德州", "潍坊", "临沂"]
    got = one("记录潍坊市各监测站点数据，结构与德州市一致。监测时间：2025-11-25 09:00:00.0", lambda c: dates.table_context(c, names))
    assert got == ("潍坊", "2025-11-25", "09")
    assert one("临沂 2025年1月2日8:00", lambda c: dates.table_context(c, names)) == ("临沂", "2025-01-02", None)
    assert one("德州与临沂", lambda c: dates.table_context(c, names)) == (None, None, None)


def test_compress(one):
    body = "青岛市表现突出，GDP 16,719.5 亿元，常住人口 1044 万，人均 16.2 万元；前景广阔。"
    assert one(body, text.compress_text) == "青岛市表现突出，GDP 16,719.5 亿元，常住人口 1044 万，人均 16.2 万元"
    assert one("只有 12 个", text.compress_text) is None
    assert one("只有 12 个病例", lambda c: text.compress_text(c, keep_keywords=["病例"])) == "只有 12 个病例"


def test_keywords(one):
    assert one("2025_City-report 城市 city 12 模板 城市经济", text.keywords) == ["City", "城市", "城市经济"]
    assert one("2025年城市经济-模板 A1 report_v2.xlsx", text.filename_keywords) == ["年城市经济", "A1", "report_v2"]


def test_collapse_spaces(one):
    assert one("人均 GDP 达到 5 万元 左右", text.collapse_cjk_spaces) == "人均GDP达到5万元 左右"


def test_replace_counted(one):
    build = lambda c: F.struct(*text.replace_counted(c, [("aa", "b"), ("b", "c")]))
    assert one("aaaab", build) == ("ccc", 5)
    first = lambda c: F.struct(*text.replace_counted(c, [("a", "x")], first_only=True))
    assert one("banana", first) == ("bxnana", 1)


def test_trigrams(one):
    assert one("a-b.xlsx", text.trigrams) == ["ab"]
    assert one("城市经济.docx", text.trigrams) == ["城市经", "市经济"]
    assert one(".xlsx", text.trigrams) == []


def test_cell_ref(spark):
    df = spark.createDataFrame([(1, 1), (2, 26), (3, 27), (4, 702), (5, 703), (6, 18278)], "r int, c int")
    got = [r[0] for r in df.select(numbers.cell_ref(F.col("r"), F.col("c"))).collect()]
    assert got == ["A1", "Z2", "AA3", "ZZ4", "AAA5", "ZZZ6"]


def test_numeric_text_and_match(spark):
    from factloom.operators.evaluation import values_match

    df = spark.createDataFrame([("1234.5", "1240"), ("12%", "0.12"), ("0.001", "0.009"), ("abc", "abd"), ("100", "102")], "e string, a string")
    assert [r[0] for r in df.select(values_match(F.col("e"), F.col("a"))).collect()] == [True, True, True, False, False]
