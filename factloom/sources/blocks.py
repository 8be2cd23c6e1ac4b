"""Texts, Markdown and tables to blocks.

A document is one row, so each text is split inside its own row with array expressions:
no shuffle, no window over a document, and the section of a block is known before the
blocks are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import LINE_BREAK, record, MARK_A, MARK_B, MARK_C, as_col, let, lines, none_if_empty, strip

TEXT_HEADING = (
    "^(?:[一二三四五六七八九十]+[、.．]|\\d{1,2}(?:\\.\\d{1,2}){0,2}[、.．])(?U:\\s*)(\\S.*)$"
)
NO_TEXTS = "array<string>"


def block_id(doc_id: Column, index: Column) -> Column:
    """Readable and unique: position inside the document."""
    return F.concat_ws("#", doc_id.cast("string"), index.cast("string"))


def block_item(kind: str, text: Column, path: Column, headers: Column | None = None,
               cells: Column | None = None) -> Column:
    none = F.lit(None).cast(NO_TEXTS)
    return record(block_type=F.lit(kind), text=text, section_path=path, headers=none if headers is None else headers, cells=none if cells is None else cells)


def paragraphs(body: Column) -> Column:
    """Runs of non-blank lines joined by a space; ``body`` holds stripped lines."""
    runs = F.transform(
        F.split(body, "\n{2,}"),
        lambda p: F.replace(F.regexp_replace(p, "^\n|\n$", ""), F.lit("\n"), F.lit(" ")),
    )
    return F.filter(runs, lambda p: p != "")


def explode_blocks(docs: DataFrame, doc_id: str, items: Column, keep: tuple[str, ...]) -> DataFrame:
    # The outer form keeps the optimizer from deriving a size filter that would split twice.
    flat = docs.select(doc_id, *keep, F.posexplode_outer(items).alias("i", "b")).where(
        F.col("i").isNotNull()
    )
    index = F.col("i") + 1
    return flat.select(
        block_id(F.col(doc_id), index).alias("block_id"),
        F.col(doc_id).cast("string").alias("doc_id"),
        "b.block_type", "b.text", "b.section_path", index.alias("page_or_index"),
        "b.headers", "b.cells", *[c for c in keep if c != doc_id],
    )


def text_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Plain text to heading and paragraph blocks; a heading resets the section path."""
    return explode_blocks(docs, doc_id, text_items(F.col(text)), keep)


def text_items(text: Column) -> Column:
    """Array of the blocks of a plain text."""
    marked = F.array_join(
        F.transform(
            lines(F.coalesce(text, F.lit(""))),
            lambda x: F.when(
                x.rlike(TEXT_HEADING),
                F.concat(F.lit(MARK_A), F.regexp_extract(x, TEXT_HEADING, 1), F.lit(MARK_B)),
            ).otherwise(x),
        ),
        "\n",
    )

    def section(part: Column, i: Column) -> Column:
        title = F.substring_index(part, MARK_B, 1)
        path = F.when(i == 0, F.array().cast(NO_TEXTS)).otherwise(F.array(title))
        body = F.when(i == 0, part).otherwise(F.substring_index(part, MARK_B, -1))
        head = F.when(i > 0, F.array(block_item("heading", title, path)))
        paras = F.transform(paragraphs(body), lambda p: block_item("paragraph", p, path))
        return F.when(i > 0, F.concat(head, paras)).otherwise(paras)

    # A text of one line that is no heading, as most short ones are, is a paragraph as it stands.
    split = F.flatten(F.transform(F.split(marked, MARK_A), section))
    single = lambda line: F.filter(F.array(block_item("paragraph", line, F.array().cast(NO_TEXTS))), lambda b: b["text"] != "")
    return F.when(~text.rlike(LINE_BREAK), let(strip(text), lambda line: F.when(line.rlike(TEXT_HEADING), split).otherwise(single(line)))).otherwise(split)


def section_paths(levels_titles: Column) -> Column:
    """Fold (level, title) headings into their section paths, one per heading."""
    start = record(path=F.array().cast(NO_TEXTS), all=F.array().cast("array<array<string>>"))

    def step(acc: Column, h: Column) -> Column:
        kept = F.slice(acc["path"], F.lit(1), F.greatest(h["level"] - 1, F.lit(0)))
        path = F.concat(kept, F.array(h["title"]))
        return record(path=path, all=F.concat(acc["all"], F.array(path)))

    return F.aggregate(levels_titles, start, step, lambda acc: acc["all"])


def pipe_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, "^\\|+|\\|+$", ""), "\\|"), strip)


def fit(cells: Column, headers: Column) -> Column:
    """Cells cut or padded with blanks to the header width."""
    n = F.size(headers)
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(n - F.size(cells), F.lit(0))))
    return F.when(F.size(cells) == n, cells).otherwise(F.slice(padded, F.lit(1), n))


def markdown_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Markdown to heading, paragraph and table_row blocks."""
    staged, items = markdown_items(docs, F.col(text))
    return explode_blocks(staged, doc_id, items, keep)


def markdown_items(docs: DataFrame, text: Column) -> tuple[DataFrame, Column]:
    """The documents with helper columns, and the array of the blocks of a Markdown text over them."""
    all_lines = lines(F.coalesce(text, F.lit("")))
    is_table = lambda x: x.startswith("|") & x.endswith("|")

    def mark(arr: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.when(i > 0, is_table(F.get(arr, i - 1))).otherwise(F.lit(False))
            turn = F.when(before != is_table(x), F.lit(MARK_C)).otherwise(F.lit(""))
            hashes = F.regexp_extract(x, "^(#+)", 1)
            title = strip(F.substring(x, F.length(hashes) + 1, F.length(x)))
            head = F.concat(F.lit(MARK_A), hashes, F.lit(MARK_B), title, F.lit(MARK_B))
            return F.concat(turn, F.when(hashes != "", head).otherwise(x))

        return F.array_join(F.transform(arr, one), "\n")

    # The lines and marked texts are materialised once per document, before they are reused.
    staged = docs.withColumn("_lines", all_lines)
    staged = staged.withColumn("_md_sections", F.split(mark(F.col("_lines")), MARK_A))
    headings = F.transform(
        F.slice(F.col("_md_sections"), F.lit(2), F.greatest(F.size("_md_sections") - 1, F.lit(0))),
        lambda s: record(level=F.length(F.substring_index(s, MARK_B, 1)), title=F.get(F.split(s, MARK_B), F.lit(1))),
    )
    staged = staged.withColumn("_md_paths", section_paths(headings))

    def table_items(piece: Column, path: Column) -> Column:
        rows = F.filter(F.split(piece, "\n"), lambda r: r != "")
        headers = pipe_cells(F.get(rows, F.lit(0)))
        data = F.transform(F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0))), pipe_cells)
        full = F.filter(data, lambda r: F.exists(r, lambda v: v != ""))
        return F.transform(
            full, lambda r: block_item("table_row", F.array_join(r, " | "), path, headers, fit(r, headers))
        )

    def section(part: Column, i: Column) -> Column:
        path = F.when(i == 0, F.array().cast(NO_TEXTS)).otherwise(F.get(F.col("_md_paths"), i - 1))
        fields = F.split(part, MARK_B, 3)
        body = F.when(i == 0, part).otherwise(F.get(fields, F.lit(2)))
        pieces = F.flatten(
            F.transform(
                F.split(body, MARK_C),
                lambda piece, k: F.when(k % 2 == 1, table_items(piece, path)).otherwise(
                    F.transform(paragraphs(piece), lambda p: block_item("paragraph", p, path))
                ),
            )
        )
        head = F.array(block_item("heading", F.get(fields, F.lit(1)), path))
        return F.when(i == 0, pieces).otherwise(F.concat(head, pieces))

    return staged, F.flatten(F.transform(F.col("_md_sections"), section))


def rows_to_blocks(df: DataFrame, doc_id: str, sheet: str, columns, index: Column | str,
                   headers=None) -> DataFrame:
    """Any wide table to table_row blocks; ``index`` gives each row its place in the document."""
    names = list(headers or columns)
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    out = df.select(cells.alias("cells"), as_col(index).cast("int").alias("page_or_index"))
    return (
        out.where(F.exists("cells", lambda v: strip(v) != ""))
        .select(
            block_id(F.lit(doc_id), F.col("page_or_index")).alias("block_id"),
            F.lit(doc_id).alias("doc_id"),
            F.lit("table_row").alias("block_type"),
            F.array_join("cells", " | ").alias("text"),
            F.array(F.lit(sheet)).alias("section_path"),
            "page_or_index",
            F.array(*[F.lit(n) for n in names]).alias("headers"),
            "cells",
        )
    )


def row_entries(headers: Column | str, cells: Column | str) -> Column:
    """array<struct<pos, header, value>>; under a repeated header every entry has the last value."""
    h, c = as_col(headers), as_col(cells)
    return F.transform(
        h,
        lambda name, i: record(pos=i + 1, header=strip(name), value=strip(
                F.coalesce(
                    F.get(c, F.size(h) - F.array_position(F.reverse(h), name).cast("int")),
                    F.lit(""),
                )
            )),
    )


def row_map(headers: Column | str, cells: Column | str) -> Column:
    """Header → value map; the last of repeated headers wins."""
    names = F.transform(as_col(headers), strip)
    firsts = F.filter(
        row_entries(headers, cells), lambda e: F.array_position(names, e["header"]) == e["pos"]
    )
    return F.map_from_entries(
        F.transform(firsts, lambda e: record(key=e["header"], value=e["value"]))
    )


def value_of(headers: Column | str, cells: Column | str, wanted: Column | str) -> Column:
    """Cell under a header; NULL when the row has no such header."""
    found = F.filter(row_entries(headers, cells), lambda e: e["header"] == as_col(wanted))
    return F.get(found, F.lit(0))["value"]


def with_context(blocks: DataFrame, size: int = 6) -> DataFrame:
    """Tables of parsed documents with the (at most six) paragraphs before them.

    Works on documents kept as one row: ``items`` is the ordered array of
    struct<kind, table_index, text>; the paragraph buffer empties at each table.
    """
    cut = F.array_join(
        F.transform(
            "items",
            lambda b: F.when(b["kind"] == "table", F.lit(MARK_A)).otherwise(
                F.concat(b["text"], F.lit(MARK_B))
            ),
        ),
        "",
    )
    # One split piece per table (the text after the last table belongs to none).
    pieces = F.split(cut, MARK_A)
    before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    tail = lambda p: F.array_join(
        F.reverse(F.slice(F.reverse(F.filter(F.split(p, MARK_B), lambda t: t != "")), F.lit(1), F.lit(size))),
        "\n",
    )
    return blocks.select(
        "doc_id", F.posexplode(F.transform(before, tail)).alias("i", "context_text")
    ).select("doc_id", (F.col("i") + 1).alias("table_index"), none_if_empty(F.col("context_text")).alias("context_text"))
