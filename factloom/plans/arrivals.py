"""Queries: office files and streams. The files are made inside tasks from the given tables."""

from __future__ import annotations

import functools
import struct
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.common import top_per_group
from factloom.plans import fixtures as fx
from factloom.plans.facts import SQL_TEXT_FACTS
from factloom.plans.registry import query
from factloom.plans.scans import SQL_ORDER_ROWS, order_rows
from factloom.session import dealt, scratch_path
from factloom.sources import office
from factloom.streaming import ingest

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
WML = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


ZIP_DATE = 1 << 5 | 1  # 1980-01-01, as a zip header writes it


@functools.lru_cache(256)
def packed(name: str, xml: str) -> tuple[bytes, bytes, bytes]:
    """A part stored in a zip archive: its place there with content, and its directory entry before and after the offset."""
    path, data = name.encode(), xml.encode()
    # Version, flags (names in UTF-8), method, time, date, checksum, sizes, length of the name, no extra field.
    head = struct.pack("<5H3L2H", 20, 0x800, 0, 0, ZIP_DATE, zlib.crc32(data), len(data), len(data), len(path), 0)
    return b"PK\3\4" + head + path + data, b"PK\1\2\x14\0" + head + bytes(10), path


def archive(parts: dict[str, str]) -> bytes:
    """A zip archive of stored parts, written at once: ``zipfile`` takes several times as long for files this small."""
    contents, directory, size = [], [], 0
    for name, xml in parts.items():
        content, entry, path = packed(name, xml)
        contents.append(content)
        directory += (entry, size.to_bytes(4, "little"), path)
        size += len(content)
    listed = b"".join(directory)
    end = struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(parts), len(parts), len(listed), size, 0)
    return b"".join((*contents, listed, end))


def make_xlsx(sheets: dict[str, list[list[str]]]) -> bytes:
    """A minimal workbook of inline strings."""
    names, rels, parts = [], [], {}
    for n, (name, rows) in enumerate(sheets.items(), start=1):
        names.append(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="r{n}"/>')
        rels.append(f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>')
        body = []
        for r, row in enumerate(rows, start=1):
            cells = "".join(
                f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(row, start=1))
            body.append(f'<row r="{r}">{cells}</row>')
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(body)}</sheetData></worksheet>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="{DOC}"><sheets>{"".join(names)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{PKG}">{"".join(rels)}</Relationships>'
    return archive(parts)


@functools.lru_cache(1024)
def paragraph(text: str, style: str = "") -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"


def word_table(rows: list[list[str]]) -> str:
    cell = lambda v: f"<w:tc>{paragraph(v)}</w:tc>"
    return f"<w:tbl>{''.join(f'<w:tr>{"".join(map(cell, row))}</w:tr>' for row in rows)}</w:tbl>"


def make_docx(body: str) -> bytes:
    return archive({"word/document.xml": f'<w:document xmlns:w="{WML}"><w:body>{body}</w:body></w:document>'})


def order_files(spark: SparkSession, folder: str, make, suffix: str) -> DataFrame:
    """One office file per order as (path, content), made from the order's own row."""
    # Making and reading files is work for every core, though the rows themselves are small.
    orders = dealt(fx.table(spark, folder, "orders"))

    def build(priority: pd.Series, status: pd.Series, *texts: pd.Series) -> pd.Series:
        return pd.Series([make(p, s, [t[:3], t[3:]]) for p, s, *t in zip(priority, status, *texts)])

    # The six texts travel as columns of their own, since nested arrays are slow to bring to pandas.
    texts = [order_rows()[row][column] for row in range(2) for column in range(3)]
    content = F.pandas_udf(build, "binary")("o_orderpriority", "o_orderstatus", *texts)
    path = F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string"), F.lit(suffix))
    return orders.select(path.alias("path"), content.alias("content"))


HEAD = ["Key", "Value", "Flag"]


def order_xlsx(priority: str, status: str, items: list[list[str]]) -> bytes:
    return make_xlsx({"items": [["", ""], [*HEAD, ""], *items, ["", ""]], "state": [["Priority", "Status"], [priority, status]]})


def order_docx(priority: str, status: str, items: list[list[str]]) -> bytes:
    return make_docx(
        paragraph("Order", "Heading1") + paragraph(f"Priority {priority}") + paragraph("Items", "Heading2")
        + word_table([HEAD, *items]) + paragraph("1.2.Status") + paragraph(f"State {status}")
        + word_table([["Status"], [status]]))


@query("scan_xlsx_rows", f"""WITH {SQL_ORDER_ROWS}
SELECT k || '.xlsx' AS doc_id, CAST(n AS INT) AS page_or_index, 'items' AS sheet, line AS text, CAST(n + 2 AS INT) AS row_index FROM i
UNION ALL SELECT k || '.xlsx', 3, 'state', p || ' | ' || s, 2 FROM o""")
def scan_xlsx_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = office.xlsx_rows(order_files(spark, folder, order_xlsx, ".xlsx"), "name")
    return rows.select("doc_id", "page_or_index", F.array_join("section_path", "/").alias("sheet"), "text", "row_index")


@query("scan_docx_blocks", f"""WITH {SQL_ORDER_ROWS}, b AS (
  SELECT k, 1 AS x, 'heading' AS t, 'Order' AS text, 'Order' AS sec FROM o
  UNION ALL SELECT k, 2, 'paragraph', 'Priority ' || p, 'Order' FROM o
  UNION ALL SELECT k, 3, 'heading', 'Items', 'Order/Items' FROM o
  UNION ALL SELECT k, 3 + n, 'table_row', line, 'Order/Items' FROM i
  UNION ALL SELECT k, 6, 'heading', '1.2.Status', 'Order/Items/1.2.Status' FROM o
  UNION ALL SELECT k, 7, 'paragraph', 'State ' || s, 'Order/Items/1.2.Status' FROM o
  UNION ALL SELECT k, 8, 'table_row', s, 'Order/Items/1.2.Status' FROM o)
SELECT k || '.docx' AS doc_id, CAST(x AS INT) AS page_or_index, t AS block_type, text, sec AS section FROM b""")
def scan_docx_blocks(spark: SparkSession, folder: str) -> DataFrame:
    b = office.docx_document_blocks(order_files(spark, folder, order_docx, ".docx"), "name")
    return b.select("doc_id", "page_or_index", "block_type", "text", F.array_join("section_path", "/").alias("section"))


@query("scan_docx_tables", f"""WITH {SQL_ORDER_ROWS}
SELECT k || '.docx' AS name, 1 AS table_index, 1 AS row_index, 'Key | Value | Flag' AS line, 'Order' || chr(10) || 'Priority ' || p || chr(10) || 'Items' AS context_text FROM o
UNION ALL SELECT i.k || '.docx', 1, CAST(i.n + 1 AS INT), line, 'Order' || chr(10) || 'Priority ' || p || chr(10) || 'Items' FROM i JOIN o ON i.k = o.k
UNION ALL SELECT k || '.docx', 2, unnest([1, 2]), unnest(['Status', s]), '1.2.Status' || chr(10) || 'State ' || s FROM o""")
def scan_docx_tables(spark: SparkSession, folder: str) -> DataFrame:
    t = office.docx_tables(order_files(spark, folder, order_docx, ".docx"))
    return t.select(F.substring_index("path", "/", -1).alias("name"), "table_index", "row_index",
                    F.array_join("values", " | ").alias("line"), "context_text")


def sentence_store(spark: SparkSession, folder: str) -> str:
    """The order sentences streamed in and ingested; every third arrives twice, first with other numbers. Returns the store."""
    base = scratch_path(spark, "ingest")
    docs = fx.customer_text(spark, folder).select("doc_id", "text", "file_name")
    early = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    wrong = docs.where(early).withColumn("text", F.regexp_replace("text", "total price of ", "total price of 9"))
    for arriving in (wrong, docs):
        arriving.write.mode("append").parquet(f"{base}/inbox")
        stream = spark.readStream.schema(docs.schema).parquet(f"{base}/inbox")
        ingest.ingest_stream(stream, f"{base}/store", f"{base}/offsets", ingest.text_pipeline(fx.VOCAB)).awaitTermination()
    return f"{base}/store"


@query("incremental_ingest", f"""{SQL_TEXT_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY nation, field_name, y ORDER BY split_part(fact_id, '#', 1) DESC, fact_id DESC) AS rn FROM spans)
SELECT fact_id, nation AS entity_name, field_name, value_num, y AS year, rn = 1 AS is_canonical FROM r""")
def incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.canonical_store(spark, sentence_store(spark, folder)).select(
        "fact_id", "entity_name", "field_name", "value_num", "year", "is_canonical")


@query("ingest_progress", f"""WITH {fx.SQL_CUSTOMER_TEXT} SELECT doc_id, 'parsed' AS status, 1 AS block_count, 2 AS fact_count FROM sentences""")
def ingest_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The latest arrival of each document."""
    arrivals = ingest.progress_table(spark, sentence_store(spark, folder))
    return top_per_group(arrivals, ["doc_id"], [F.desc("batch_id")]).select("doc_id", "status", "block_count", "fact_count")
