from __future__ import annotations

from pyspark.sql import functions as F

from factloom.sources.blocks import markdown_blocks, row_map, rows_to_blocks, text_blocks, with_context


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("doc_id", "page_or_index").select(*cols).collect()]


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_text_blocks(spark):
    got = rows(text_blocks(docs(spark, "前言\n一、总则\n第一行\n  第二行 \n\n第三\r\n1.2.标题二\n内容\n2、\n", "", "\n \n")), "block_type", "text", "section_path")
    assert got == [
        ("paragraph", "前言", []), ("heading", "总则", ["总则"]), ("paragraph", "第一行 第二行", ["总则"]),
        ("paragraph", "第三", ["总则"]), ("heading", "标题二", ["标题二"]), ("paragraph", "内容 2、", ["标题二"]),
    ]


def test_markdown_blocks(spark):
    body = "intro\n# A\ntext\nline\n| h1 | h2 |\n|---|---|\n| 1 | 2 |\n| | |\n| 4 |\nafter\n### C\n## D\n|x|\n#### E\n|k|v|\n|-|-|\n|1|2|"
    got = rows(markdown_blocks(docs(spark, body)), "block_type", "text", "section_path")
    assert got == [
        ("paragraph", "intro", []), ("heading", "A", ["A"]), ("paragraph", "text line", ["A"]), ("table_row", "1 | 2", ["A"]),
        ("table_row", "4", ["A"]), ("paragraph", "after", ["A"]), ("heading", "C", ["A", "C"]), ("heading", "D", ["A", "D"]),
        ("heading", "E", ["A", "D", "E"]), ("table_row", "1 | 2", ["A", "D", "E"]),
    ]


def test_repeated_headers_take_the_last_value(spark):
    b = markdown_blocks(docs(spark, "|a|b|a|\n|-|-|-|\n|1|2|3|\n|4|")).orderBy("page_or_index")
    assert [r[0] for r in b.select(row_map("headers", "cells")).collect()] == [{"a": "3", "b": "2"}, {"a": "", "b": ""}]


def test_rows_to_blocks_skips_blank_rows(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, " "), (3, "y", "z")], "i int, a string, b string")
    got = rows(rows_to_blocks(df, "d", "s", ["a", "b"], "i"), "block_id", "text")
    assert got == [("d#1", "x | "), ("d#3", "y | z")]


def test_table_context_buffer(spark):
    kinds = [("p", "one"), ("p", "two"), ("table", ""), ("table", ""), *[("p", str(i)) for i in range(8)], ("table", ""), ("p", "tail")]
    df = spark.createDataFrame([("d", kinds)], "doc_id string, items array<struct<kind:string,text:string>>")
    got = [tuple(r) for r in with_context(df).orderBy("table_index").select("table_index", "context_text").collect()]
    assert got == [(1, "one\ntwo"), (2, None), (3, "2\n3\n4\n5\n6\n7")]


def test_whole_text_survives(spark):
    body = "\n".join(f"line {i}" for i in range(20_000))
    out = text_blocks(docs(spark, body)).select(F.length("text")).first()[0]
    assert out == len(body)
