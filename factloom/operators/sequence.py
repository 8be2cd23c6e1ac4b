"""Ordered text work: section paths, chunks, samples, previews, histories."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import let, record, strip
from factloom.operators.common import carry_forward, rank_by_position, top_per_group
from factloom.operators.extraction import nearest_entity
from factloom.session import materialised


def with_section_path(lines: DataFrame, key: str, pos: str, level: str, title: str) -> DataFrame:
    """Current heading path on every line, for documents stored as line tables.

    ``level`` is NULL for plain lines; the levels that occur are read from the data, however deep. The latest heading of each
    level is carried forward; a level belongs to the path when no shallower heading came after it. (Where a document
    skips levels, ``sources.blocks.markdown_blocks`` keeps headings by depth instead.)
    """
    levels = sorted(r[0] for r in lines.select(level).where(F.col(level).isNotNull()).distinct().collect())
    values = {
        f"_h{n}": F.when(F.col(level) == n, F.struct(F.col(pos).alias("at"), F.col(title).alias("t"))) for n in levels
    }
    carried = carry_forward(lines, [key], pos, values)
    path = []
    for place, n in enumerate(levels):
        mine = F.col(f"_h{n}")
        newer = F.lit(False)
        for up in levels[:place]:
            newer = newer | F.coalesce(F.col(f"_h{up}.at") > mine["at"], F.lit(False))
        path.append(F.when(mine.isNotNull() & ~newer, mine["t"]))
    empty = F.array().cast("array<string>")
    return carried.withColumn("section_path", F.array_compact(F.array(*path)) if path else empty).drop(*values)


def nearest_entity_at(texts: DataFrame, positions: str, anchors: str) -> DataFrame:
    """Anchors exploded with the nearest preceding entity of their own text."""
    return texts.select(
        "*", F.explode(anchors).alias("anchor")
    ).withColumn("entity", nearest_entity(F.col(positions), F.col("anchor")))


def _opened(lengths: Column, used: Column, max_chars: int) -> Column:
    """Places (from 0) of the texts that open a chunk, ``used`` characters of an open chunk standing before the first one (0: none)."""
    start = record(at=F.lit(0), used=used.cast("int"), opened=F.array().cast("array<int>"))

    def step(acc: Column, n: Column) -> Column:
        opens = (acc["used"] == 0) | (acc["used"] + n > max_chars)
        return record(
            at=acc["at"] + 1, used=F.when(opens, n + 1).otherwise(acc["used"] + n + 1),
            opened=F.when(opens, F.concat(acc["opened"], F.array(acc["at"]))).otherwise(acc["opened"]))

    return F.aggregate(lengths, start, step, lambda acc: acc["opened"])


def _pieces(texts: Column, opened: Column) -> Column:
    """The texts before the first opened place, and those from each opened place to the next, joined by line breaks (null: none)."""
    bound = record(t=texts, e=F.concat(F.array(F.lit(0)), opened, F.array(F.size(texts))))

    def cut(b: Column) -> Column:
        at = lambda i: F.get(b["e"], i)
        return F.transform(F.sequence(F.lit(0), F.size(b["e"]) - 2), lambda i: F.when(
            at(i + 1) > at(i), F.array_join(F.slice(b["t"], at(i) + 1, at(i + 1) - at(i)), "\n")))

    return let(bound, cut)


def chunk_texts(texts: Column, max_chars: int) -> Column:
    """Greedy packing of an ordered array of texts; a line break is counted per text."""
    clean = F.filter(F.transform(texts, strip), lambda t: t != "")
    return let(clean, lambda c: F.array_compact(_pieces(c, _opened(F.transform(c, F.length), F.lit(0), max_chars))))


def chunk_documents(docs: DataFrame, doc_id: str, texts: Column, max_chars: int = 3000) -> DataFrame:
    """Chunks of documents that are one row each (``texts`` = their ordered block texts)."""
    return docs.select(
        F.col(doc_id), F.posexplode_outer(chunk_texts(texts, max_chars)).alias("i", "chunk")
    ).where(F.col("i").isNotNull()).select(doc_id, (F.col("i") + 1).alias("chunk_no"), "chunk")


CHUNK_SLICE = 1_024  # positions of a document that are packed together


def _slice_summary(lengths: np.ndarray, max_chars: int) -> dict:
    """What a slice makes of any number of characters that an open chunk brings along.

    ``ends[k]`` are the characters up to the end of text k. With u characters brought along the first break is at the first k
    with ends[k] > max_chars - u; a slice that breaks first at k leaves ``used[k]`` characters open and begins ``opened[k]`` chunks.
    """
    n = lengths.size
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    ends = begins[:-1] + lengths
    following = np.maximum(np.searchsorted(ends, max_chars + begins[:-1], side="right"), np.arange(1, n + 1))
    # The last chunk begun from each place on, and how many are begun, by pointer doubling.
    last = np.where(following >= n, np.arange(n), following)
    opened = np.where(following >= n, 0, 1)
    while (last[last] != last).any():
        opened, last = opened + opened[last], last[last]
    seen = min(n, int(np.searchsorted(ends, max_chars, side="right")) + 1)
    return {"ends": ends[:seen], "used": (begins[n] - begins[last])[:seen], "opened": (opened + 1)[:seen], "total": int(begins[n])}


def _entries(slices: list[dict], max_chars: int) -> Iterator[dict]:
    """Characters that each slice of a document finds open, and the chunks begun before it."""
    used, begun = 0, 0
    for s in slices:
        yield {"slice": s["slice"], "used": used, "begun": begun}
        k = bisect.bisect_right(s["ends"], max_chars - used) if used else 0
        if k < len(s["ends"]):
            used, begun = s["used"][k], begun + s["opened"][k]
        else:
            used += s["total"]


def chunk_blocks(blocks: DataFrame, key: str = "doc_id", pos: str = "page_or_index", max_chars: int = 3000, width: int = CHUNK_SLICE) -> DataFrame:
    """Chunks of a block table: the block texts of each document packed in the order of ``pos`` (nulls first, ties by text).

    A document is cut into slices of ``width`` positions. Each slice says in a short table what it makes of any open chunk
    before it, so the open chunk of every slice follows from these tables alone; each slice then packs its own texts, and
    only the pieces of a chunk are put together. No task holds a whole document.
    """
    clean = blocks.select(key, F.col(pos).alias("at"), strip("text").alias("t")).where("t <> ''")
    at_slice = F.coalesce(F.floor(F.col("at") / width), F.lit(-(1 << 62))).cast("long").alias("_slice")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda b: b["t"])
    cut = materialised(clean.groupBy(key, at_slice).agg(ordered.alias("_texts")), "slices")

    @F.arrow_udf("struct<ends:array<int>,used:array<int>,opened:array<int>,total:int>")
    def summary(lengths: pa.Array) -> pa.Array:
        kind = pa.struct([*((c, pa.list_(pa.int32())) for c in ("ends", "used", "opened")), ("total", pa.int32())])
        return pa.array([_slice_summary(np.array(n, np.int64), max_chars) for n in lengths.to_pylist()], kind)

    @F.arrow_udf("array<struct<slice:bigint,used:int,begun:int>>")
    def entries(slices: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("slice", pa.int64()), ("used", pa.int32()), ("begun", pa.int32())]))
        return pa.array([list(_entries(s, max_chars)) for s in slices.to_pylist()], kind)

    # Documents of one slice begin with nothing open; only the others need the tables.
    long = cut.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))
    told = cut.join(long, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(
        F.col(key).alias("_key"), "_slice", summary(F.transform("_texts", F.length)).alias("s"))
    by_document = told.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.col("_slice").alias("slice"), "s.ends", "s.used", "s.opened", "s.total"))).alias("s"))
    entered = by_document.select("_key", F.inline(entries("s"))).withColumnRenamed("slice", "_at")
    known = cut.join(entered, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_at")), "left")
    used, begun = F.coalesce("used", F.lit(0)), F.coalesce("begun", F.lit(0))
    packed = known.withColumn("_opened", _opened(F.transform("_texts", F.length), used, max_chars))
    pieces = packed.select(key, "_slice", begun.alias("_begun"), F.posexplode(_pieces(F.col("_texts"), F.col("_opened"))).alias("_i", "_piece")).where("_piece is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_slice", "_piece"))), lambda p: p["_piece"]), "\n")
    return pieces.groupBy(key, (F.col("_begun") + F.col("_i")).alias("chunk_no")).agg(joined.alias("chunk"))


def sample_paragraphs(blocks: DataFrame, key: str = "doc_id", pos: str = "page_or_index",
                      head: int = 8, middle: int = 4, tail: int = 4, chars: int = 500,
                      budget: int = 6000) -> DataFrame:
    """First, middle and last paragraphs of each document within a character budget.

    Ranks come from slice-wise numbering; only the at most 16 picked rows of a document
    are then ordered together for the budget.
    """
    counts = blocks.groupBy(key).agg(F.count("*").alias("n"))
    ranked = rank_by_position(blocks, pos, [key], "k").join(counts, key)
    mid = F.floor(F.col("n") / 2).cast("int") - 2
    at = F.col("k") - 1
    part = (
        F.when(at < head, "head")
        .when((F.col("n") > 16) & (at >= mid) & (at < mid + middle), "middle")
        .when((F.col("n") > 20) & (at >= F.col("n") - tail), "tail")
    )
    # A paragraph can be picked by more than one part of a short document.
    picks = F.array_compact(F.array(
        F.when(at < head, record(o=F.lit(0), part=F.lit("head"))),
        F.when((F.col("n") > 16) & (at >= mid) & (at < mid + middle), record(o=F.lit(1), part=F.lit("middle"))),
        F.when((F.col("n") > 20) & (at >= F.col("n") - tail), record(o=F.lit(2), part=F.lit("tail"))),
    ))
    picked = ranked.where(part.isNotNull()).select(
        key, "k", F.left("text", F.lit(chars)).alias("sample"), F.inline(picks)
    )
    order = Window.partitionBy(key).orderBy("o", "k").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.length("sample") + 20).over(order), F.lit(0))
    return picked.withColumn("_spent", spent).where(F.col("_spent") < budget).select(
        key, "part", (F.col("k") - 1).alias("paragraph"), "sample"
    )


def assemble_preview(blocks: DataFrame, dimension: str = "", max_rows: int = 200, max_texts: int = 30,
                     chars: int = 500, budget: int = 10_000) -> DataFrame:
    """Preview text per document: table rows first, then text blocks with dimension hits first.

    At most 230 blocks per document survive the group limits before they are joined.
    """
    short = blocks.withColumn("t", F.left("text", F.lit(chars)))
    hit = F.when(F.contains(F.lower("text"), F.lit(dimension.lower())), 0).otherwise(1) if dimension else F.lit(0)
    idx = F.coalesce("page_or_index", F.lit(0))
    rows = top_per_group(
        short.where("block_type = 'table_row'").select("doc_id", "t", idx.alias("i"), "block_id"),
        ["doc_id"], [F.asc("i"), F.asc("block_id")], max_rows, rank="k",
    ).select("doc_id", F.struct(F.lit(0).alias("o"), "k", "t").alias("p"))
    texts = top_per_group(
        short.where("block_type in ('paragraph','heading','page')").select(
            "doc_id", "t", hit.alias("h"), idx.alias("i"), "block_id"),
        ["doc_id"], [F.asc("h"), F.asc("i"), F.asc("block_id")], max_texts, rank="k",
    ).select("doc_id", F.struct(F.lit(1).alias("o"), "k", "t").alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n")
    return rows.unionByName(texts).groupBy("doc_id").agg(F.left(joined, F.lit(budget)).alias("preview"))


def trim_history(messages: DataFrame, conv: str = "conv_id", turn: str = "turn",
                 above: int = 40, keep: int = 30) -> DataFrame:
    """Messages of each conversation; only the last ``keep`` when there are more than ``above``.

    The group limit keeps at most ``above`` rows per conversation and task.
    """
    counts = messages.groupBy(conv).agg(F.count("*").alias("_n"))
    last = top_per_group(messages, [conv], [F.desc(turn)], above, rank="_rn")
    return last.join(counts, conv).where((F.col("_n") <= above) | (F.col("_rn") <= keep)).drop("_n", "_rn")


def conversation_titles(messages: DataFrame, conv: str = "conv_id", turn: str = "turn",
                        chars: int = 30) -> DataFrame:
    """Title of a conversation: the start of its first user message."""
    first = top_per_group(messages.where("role = 'user'"), [conv], [F.asc(turn)])
    title = F.concat(F.left("text", F.lit(chars)), F.when(F.length("text") > chars, "…").otherwise(""))
    return first.select(conv, title.alias("title"))
