"""Office files, encodings and the incremental ingest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.operators.canonical import elect_canonical
from factloom.operators.extraction import extract_facts
from factloom.plans.arrivals import HEAD, make_docx, make_xlsx, order_docx, order_files, paragraph, word_table
from factloom.session import dealt
from factloom.sources import office
from factloom.sources.blocks import row_map, text_blocks
from factloom.streaming import ingest
from factloom.streaming.listener import ProgressLog
from tests.test_facts import VOCAB


def test_workbooks_and_a_bad_file(spark, tmp_path):
    sheets = {"甲": [["", ""], ["城市 ", "GDP", ""], ["济南", "5"], ["", ""], ["青岛"], ["x", "1", "cut"]], "空": [], "乙": [["k"], ["v"]]}
    (tmp_path / "a.xlsx").write_bytes(make_xlsx(sheets))
    (tmp_path / "b.xlsx").write_bytes(b"not a zip")
    got = office.xlsx_rows(office.binary_files(spark, f"{tmp_path}/*.xlsx"), "name")
    rows = got.where("error is null").orderBy("page_or_index").select("page_or_index", "text", "section_path", "row_index").collect()
    assert [tuple(r) for r in rows] == [
        (1, "济南 | 5", ["甲"], 3), (2, "青岛 | ", ["甲"], 5), (3, "x | 1", ["甲"], 6), (4, "v", ["乙"], 2)]
    bad = got.where("error is not null").collect()
    assert [(r["doc_id"], r["block_id"]) for r in bad] == [("b.xlsx", None)]


def test_word_documents(spark, tmp_path):
    span = '<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc>'
    merged = '<w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p><w:r><w:t>hidden</w:t></w:r></w:p></w:tc>'
    table = word_table([["a", "b", "c"]]).replace("</w:tbl>", f"<w:tr>{span}{merged}</w:tr></w:tbl>")
    body = (paragraph("总览", "Heading1") + paragraph("正文") + paragraph("1.1、背景") + paragraph("一、开始")
            + paragraph("题", "标题样式") + table + word_table([["only"]]))
    (tmp_path / "a.docx").write_bytes(make_docx(body))
    files = office.binary_files(spark, f"{tmp_path}/*.docx")
    got = office.docx_document_blocks(files, "name").orderBy("page_or_index")
    assert [(r["block_type"], r["text"], r["section_path"]) for r in got.collect()] == [
        ("heading", "总览", ["总览"]), ("paragraph", "正文", ["总览"]), ("heading", "1.1、背景", ["总览", "1.1、背景"]),
        ("heading", "一、开始", ["一、开始"]), ("heading", "题", ["题"]), ("table_row", "wide |  | ", ["题"])]
    row = got.where("cells is not null").select(row_map("headers", "cells").alias("m")).first()["m"]
    assert row == {"a": "wide", "b": "", "c": ""}
    tables = office.docx_tables(files).orderBy("table_index", "row_index").collect()
    assert [(r["table_index"], r["row_index"], r["context_text"]) for r in tables] == [
        (1, 1, "总览\n正文\n1.1、背景\n一、开始\n题"), (1, 2, "总览\n正文\n1.1、背景\n一、开始\n题"), (2, 1, "")]
    assert HEAD


def test_small_files_share_a_batch_and_large_ones_do_not(monkeypatch):
    files = [("a.docx", make_docx(paragraph("x"))), ("b.txt", b"y" * 50), ("c.txt", b"z"), ("d.xlsx", b"damaged")] * 2
    batch = pa.RecordBatch.from_pylist([{"path": p, "content": c} for p, c in files])
    whole = list(office._open(iter([batch])))
    assert [b.num_rows for b in whole] == [8]
    monkeypatch.setattr(office, "OPENED_BYTES", 60)
    cut = list(office._open(iter([batch])))
    assert [b.num_rows for b in cut] == [1, 3, 1, 3]
    assert pa.Table.from_batches(cut).to_pylist() == pa.Table.from_batches(whole).to_pylist()


def test_orders_in_one_split_are_dealt_to_all_cores(spark):
    """On a cluster the setting of local sessions is absent, and a small file is one split."""
    set_ = spark.conf.get("spark.factloom.scan.partitions")
    spark.conf.unset("spark.factloom.scan.partitions")
    try:
        files = order_files(spark, "/root/testdata/sf0.001", order_docx, ".docx")
        assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert dealt(spark.range(0, 1000, 1, 1), 10).rdd.getNumPartitions() == 100
    finally:
        spark.conf.set("spark.factloom.scan.partitions", set_)


def test_text_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("济南".encode())
    (tmp_path / "b.txt").write_bytes("济南".encode("gbk"))
    got = {r["path"][-5:]: r["text"] for r in office.text_files(office.binary_files(spark, f"{tmp_path}/*.txt")).collect()}
    assert got == {"a.txt": "济南", "b.txt": "济南"}


def test_ingest_equals_batch_and_survives_a_retry(spark, tmp_path):
    schema = "doc_id string, text string, file_name string"
    log = ProgressLog()
    spark.streams.addListener(log)
    batches = [
        [("1", "济南 GDP总量 3亿元", "a.txt"), ("2", None, "b.txt")],
        [("3", "2020年济南 GDP总量 4亿元", "c.txt"), ("4", "济南 GDP总量 5亿元，常住人口 10万", "d.txt")],
    ]
    all_docs = spark.createDataFrame([d for b in batches for d in b if d[1]], schema)
    store = str(tmp_path / "store")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "inbox"))
        ingest.ingest_stream(stream, store, str(tmp_path / "offsets"), ingest.text_pipeline(VOCAB)).awaitTermination()
    ingest.write_batch(spark.createDataFrame(batches[1], schema), 1, store, ingest.text_pipeline(VOCAB))  # retry
    blocks = text_blocks(all_docs, keep=("file_name",))
    want = elect_canonical(extract_facts(blocks, VOCAB))
    key = lambda df: sorted((r["fact_id"], r["is_canonical"]) for r in df.select("fact_id", "is_canonical").collect())
    assert key(ingest.canonical_store(spark, store)) == key(want)
    progress = {r["doc_id"]: (r["status"], r["fact_count"]) for r in ingest.progress_table(spark, store).collect()}
    assert progress == {"1": ("parsed", 1), "2": ("failed", 0), "3": ("parsed", 1), "4": ("parsed", 2)}
    spark.streams.removeListener(log)
    assert log.table(spark).where(F.col("state") == "progress").count() >= 1
    held = log.table(spark).count()
    assert log.flush(spark, str(tmp_path / "progress-log")) == held and log.flush(spark, str(tmp_path / "progress-log")) == 0
    assert spark.read.parquet(str(tmp_path / "progress-log")).count() == held


def test_files_of_all_kinds_stream_in(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text("济南 GDP总量 3亿元")
    (inbox / "b.txt").write_text("提示词：请填写济南 GDP总量 9亿元")
    (inbox / "c.md").write_text("|城市|GDP总量（亿元）|\n|-|-|\n|青岛|7|")
    (inbox / "d.xlsx").write_bytes(make_xlsx({"s": [["城市", "常住人口"], ["上海", "2487万人"]]}))
    (inbox / "e.docx").write_bytes(make_docx(paragraph("北京GDP总量 4万亿元")))
    (inbox / "f.xlsx").write_bytes(b"damaged")
    (inbox / "g.bin").write_bytes(b"?")
    files = office.arriving_files(spark, str(inbox), 4)
    store = str(tmp_path / "store")
    ingest.ingest_stream(files, store, str(tmp_path / "offsets"), ingest.file_pipeline(VOCAB)).awaitTermination()
    facts = {(r["source_doc_id"].rsplit("/", 1)[1], r["entity_name"], r["field_name"], r["value_num"]) for r in ingest.canonical_store(spark, store).collect()}
    assert facts == {("a.txt", "济南", "GDP总量", 3.0), ("c.md", "青岛", "GDP总量", 7.0), ("d.xlsx", "上海", "常住人口", 2487.0),
                     ("e.docx", "北京", "GDP总量", 40000.0)}
    status = {r["doc_id"].rsplit("/", 1)[1]: r["status"] for r in ingest.progress_table(spark, store).collect()}
    assert {k for k, v in status.items() if v == "failed"} == {"f.xlsx", "g.bin"}
    assert len(status) == 7


SENTENCES = "doc_id string, text string, file_name string"


def put(spark, store, batch, rows):
    ingest.write_batch(spark.createDataFrame(rows, SENTENCES), batch, store, ingest.text_pipeline(VOCAB))


def elected_values(spark, store):
    return sorted((r["source_doc_id"], r["value_num"], r["is_canonical"]) for r in ingest.canonical_store(spark, store).collect())


def test_a_document_that_comes_again_replaces_itself(spark, tmp_path):
    store = str(tmp_path / "store")
    put(spark, store, 0, [("1", "济南 GDP总量 10亿元", "a.txt")])
    put(spark, store, 1, [("1", "济南 GDP总量 10亿元", "a.txt"), ("2", "济南 GDP总量 7亿元", "b.txt")])
    put(spark, store, 2, [("1", "济南 GDP总量 99亿元", "a.txt")])
    assert elected_values(spark, store) == [("1", 99.0, False), ("2", 7.0, True)]
    ingest.compact(spark, store)
    assert elected_values(spark, store) == [("1", 99.0, False), ("2", 7.0, True)]
    put(spark, store, 3, [("2", None, "b.txt")])  # the winner's document is gone: its group is elected anew
    assert elected_values(spark, store) == [("1", 99.0, True)]
    put(spark, store, 4, [("3", "济南 GDP总量 5亿元", "c.txt")])
    ingest.compact(spark, store)
    assert elected_values(spark, store) == [("1", 99.0, False), ("3", 5.0, True)]


def test_reviews_and_deletions_are_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    put(spark, store, 0, [("1", "济南 GDP总量 10亿元", "a.txt"), ("2", "济南 GDP总量 7亿元", "b.txt")])
    fact = {r["source_doc_id"]: r["fact_id"] for r in ingest.canonical_store(spark, store).collect()}
    review = spark.createDataFrame([(fact["2"], "rejected", "x", None, "2024-01-01")], "fact_id string, status string, reviewer string, note string, reviewed_at string")
    assert ingest.next_batch(spark, store) == 1
    ingest.write_reviews(review, 1, store)
    assert elected_values(spark, store) == [("1", 10.0, True), ("2", 7.0, False)]
    put(spark, store, 2, [("2", "济南 GDP总量 8亿元", "b.txt")])  # arrived again: unreviewed
    assert elected_values(spark, store) == [("1", 10.0, False), ("2", 8.0, True)]
    ingest.write_deletions(spark.createDataFrame([("2",)], "doc_id string"), ingest.next_batch(spark, store), store)
    assert elected_values(spark, store) == [("1", 10.0, True)]
    assert [r["doc_id"] for r in ingest.current_blocks(spark, store).collect()] == ["1"]


def test_snapshots_hold_the_state_and_bound_what_is_read(spark, tmp_path):
    store = str(tmp_path / "store")
    for n in range(5):
        put(spark, store, n, [("1", f"济南 GDP总量 {n}亿元", "a.txt"), (f"d{n}", f"青岛 GDP总量 {n}亿元", "b.txt")])
    fact = next(r["fact_id"] for r in ingest.canonical_store(spark, store).collect() if r["source_doc_id"] == "d4")
    review = [(fact, "rejected", "x", None, "2024-01-01"), ("gone", "rejected", "x", None, "2024-01-01")]
    ingest.write_reviews(spark.createDataFrame(review, "fact_id string, status string, reviewer string, note string, reviewed_at string"), 5, store)
    ingest.write_deletions(spark.createDataFrame([("d3",)], "doc_id string"), 6, store)
    before = elected_values(spark, store)
    assert before == [("1", 4.0, True), ("d0", 0.0, False), ("d1", 1.0, False), ("d2", 2.0, True), ("d4", 4.0, False)]
    assert ingest.compact(spark, store) == 6 and ingest.compact(spark, store) == 6
    assert elected_values(spark, store) == before
    ingest.expire(spark, store)
    assert elected_values(spark, store) == before and ingest.next_batch(spark, store) == 7
    assert [p for t in ingest.TABLES for p in (tmp_path / "store" / t).glob("batch_id=*")] == []
    versions = spark.read.parquet(f"{store}/snapshots/upto=6/facts").collect()
    assert len(versions) == 5  # replaced and deleted versions are gone
    assert len(ingest.read_table(spark, store, "reviews").collect()) == 1
    assert ingest.progress_table(spark, store).count() == 11
    put(spark, store, 7, [("d2", "青岛 GDP总量 1亿元", "b.txt")])
    assert elected_values(spark, store) == [("1", 4.0, True), ("d0", 0.0, False), ("d1", 1.0, False), ("d2", 1.0, True), ("d4", 4.0, False)]
    assert len(ingest.read_table(spark, store, "facts").inputFiles()) <= 10


def test_unfinished_batches_and_snapshots_are_not_read(spark, tmp_path):
    store = str(tmp_path / "store")
    put(spark, store, 0, [("1", "济南 GDP总量 1亿元", "a.txt")])
    put(spark, store, 1, [("2", "济南 GDP总量 9亿元", "a.txt")])
    import shutil
    shutil.move(f"{store}/progress/batch_id=1", f"{tmp_path}/held")  # batch 1 stopped before its last table
    assert elected_values(spark, store) == [("1", 1.0, True)]
    assert ingest.compact(spark, store) == 0
    shutil.move(f"{tmp_path}/held", f"{store}/progress/batch_id=1")
    ingest.compact(spark, store)
    shutil.move(f"{store}/snapshots/upto=1/committed", f"{tmp_path}/mark")  # and this snapshot before its mark
    assert ingest.snapshot(spark, store) == 0
    assert elected_values(spark, store) == [("1", 1.0, False), ("2", 9.0, True)]
    put(spark, store, 1, [("2", "济南 GDP总量 9亿元", "a.txt")])  # the retry
    assert ingest.compact(spark, store) == 1
    assert elected_values(spark, store) == [("1", 1.0, False), ("2", 9.0, True)]


def test_an_id_twice_in_one_batch_counts_once(spark, tmp_path):
    store = str(tmp_path / "store")
    put(spark, store, 0, [("1", "济南 GDP总量 3亿元", "a.txt"), ("1", "济南 GDP总量 5亿元", "a.txt"), ("1", None, "a.txt"), ("2", "济南 GDP总量 1亿元", "b.txt"), ("2", "济南 GDP总量 1亿元", "b.txt")])
    assert elected_values(spark, store) == [("1", 5.0, False), ("2", 1.0, True)]
    assert sorted((r["doc_id"], r["status"], r["fact_count"]) for r in ingest.progress_table(spark, store).collect()) == [("1", "parsed", 1), ("2", "parsed", 1)]


def test_equal_base_names_and_one_read_per_file(spark, tmp_path):
    for folder, value in (("x", 3), ("y", 4)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.txt").write_text(f"济南 GDP总量 {value}亿元")
    blocks = office.file_blocks(office.binary_files(spark, f"{tmp_path}/*/*.txt"))
    rows = blocks.collect()
    assert len({r["doc_id"] for r in rows}) == len({r["block_id"] for r in rows}) == 2 and {r["file_name"] for r in rows} == {"a.txt"}
    assert blocks._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile") == 1


def test_instruction_marker_counts_in_bytes(spark, tmp_path):
    (tmp_path / "near.txt").write_text("济" * 600 + " 提示词 GDP总量 3亿元")
    (tmp_path / "far.txt").write_text("济" * 1000 + " 提示词 济南 GDP总量 3亿元")
    files = office.binary_files(spark, f"{tmp_path}/*.txt")
    facts = ingest.file_pipeline(VOCAB).to_facts(office.file_blocks(files).where("error is null"))
    assert {r["source_doc_id"].rsplit("/", 1)[1] for r in facts.collect()} == {"far.txt"}


def test_shared_strings_references_and_wide_columns(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = (f'<x:worksheet xmlns:x="{main}"><x:sheetData><x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c><x:c r="AB1" t="s"><x:v>1</x:v></x:c></x:row>'
             '<x:row r="3"><x:c r="A3"/><x:c r="AB3"><x:v>4.5</x:v></x:c></x:row></x:sheetData></x:worksheet>')
    from factloom.plans.arrivals import archive
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="u"><sheets><sheet name="A &amp; B" sheetId="1" r:id="q"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="q" Target="/xl/worksheets/one.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>c&#233;</t></si><si><r><t>G</t></r><r><t xml:space='preserve'>DP &lt;1&gt;</t></r></si></sst>",
        "xl/worksheets/one.xml": sheet,
    }
    (tmp_path / "a.xlsx").write_bytes(archive(parts))
    (row,) = office.xlsx_rows(office.binary_files(spark, f"{tmp_path}/*.xlsx"), "name").collect()
    assert row["section_path"] == ["A & B"] and row["row_index"] == 3
    assert row["headers"][0] == "cé" and row["headers"][27] == "GDP <1>" and row["cells"][27] == "4.5" and row["cells"][0] == ""
