"""Stored tables: registry, block replacement, upserts, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed_values as fv
from factloom.functions.text import record, strings
from factloom.operators.common import top_per_group


def is_instruction(file_name: Column, head: Column) -> Column:
    """Text files that tell how to fill a template instead of holding facts."""
    base = F.lower(F.substring_index(file_name, "/", -1))
    marked = F.lit(False)
    for marker in fv.INSTRUCTION_MARKERS:
        marked = marked | F.contains(F.lower(head), F.lit(marker))
    return base.endswith(".txt") & (F.contains(F.upper(file_name), F.lit("README")) | marked)


def first_bytes(text: Column, n: int = 2048) -> Column:
    """Text of the first bytes of a text in UTF-8; a character cut in two is no marker's."""
    return F.substring(text.cast("binary"), 1, n).cast("string")


def register_documents(files: DataFrame) -> DataFrame:
    """Documents with role and skip flag.

    ``files(doc_id, file_name, head, status, document_set_id)`` where ``head`` is the text of the first 2 048 bytes.
    Only instruction texts are skipped, whatever the size of a document.
    """
    prompt = is_instruction(F.col("file_name"), F.coalesce("head", F.lit("")))
    role = F.when(prompt, "prompt_instruction").otherwise("source_document")
    return files.withColumn("doc_type", F.lower(F.substring_index("file_name", ".", -1))).withColumn(
        "document_role", role).withColumn("skip_extraction", prompt).drop("head")


def replace_blocks(store: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """All blocks of the documents in ``new`` replaced by its blocks."""
    ids = new.select(key).distinct()
    return store.join(ids, key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(base: DataFrame, updates: DataFrame, key, order: str) -> DataFrame:
    """Insert or replace by key: updates replace stored rows, the newest update wins."""
    keys = [key] if isinstance(key, str) else list(key)
    both = base.withColumn("_src", F.lit(0)).unionByName(
        updates.withColumn("_src", F.lit(1)), allowMissingColumns=True
    )
    return top_per_group(both, keys, [F.desc("_src"), F.desc(order)]).drop("_src")


def write_result(cells: DataFrame, path: str, mode: str = "append") -> None:
    """Filled cells (one row per cell, warnings beside them) partitioned by task."""
    cells.write.mode(mode).partitionBy("task_id").parquet(path)


def read_result(spark: SparkSession, path: str, task_id: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if task_id is None else out.where(F.col("task_id") == task_id)


def merge_known(first: DataFrame, second: DataFrame, key: str = "doc_id",
                keep_first=("status",)) -> DataFrame:
    """Two document lists by id: ``keep_first`` columns prefer the first, others the second."""
    a, b = first.alias("a"), second.alias("b")
    cols = []
    for name in [c for c in second.columns if c != key]:
        order = ("a", "b") if name in keep_first else ("b", "a")
        cols.append(F.coalesce(*[F.col(f"{s}.{name}") for s in order]).alias(name))
    on = F.col(f"a.{key}") == F.col(f"b.{key}")
    return a.join(b, on, "full").select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *cols
    )


def route_sources(docs: DataFrame, blocks: DataFrame, facts: DataFrame,
                  text_heavy: int = 10) -> DataFrame:
    """Per document what feeds a transform: rows, else long text, else facts, else text."""
    b = blocks.groupBy("doc_id").agg(
        F.count_if(F.col("cells").isNotNull()).alias("n_rows"),
        F.count_if(
            F.col("block_type").isin("paragraph", "heading") & (F.col("text") != "")
        ).alias("n_text"),
    )
    f = facts.groupBy(F.col("source_doc_id").alias("doc_id")).agg(F.count("*").alias("n_facts"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    source = (
        F.when(zero("n_rows") > 0, "blocks")
        .when(zero("n_text") > text_heavy, "text")
        .when(zero("n_facts") > 0, "facts")
        .when(zero("n_text") > 0, "text")
    )
    return (
        docs.select("doc_id").join(b, "doc_id", "left").join(f, "doc_id", "left")
        .select("doc_id", source.alias("source")).where(F.col("source").isNotNull())
    )


def source_rows(blocks: DataFrame, routes: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Structured rows of the documents routed to rows; a row limit per document is optional."""
    rows = blocks.where(F.col("cells").isNotNull()).join(
        routes.where("source = 'blocks'"), "doc_id", "left_semi"
    )
    if max_rows is None:
        return rows
    return top_per_group(rows, ["doc_id"], [F.asc("page_or_index")], max_rows)


def list_blocks(blocks: DataFrame, doc_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Blocks of one document by index (NULL last) and id."""
    rows = blocks.where(F.col("doc_id") == doc_id).orderBy(
        F.asc_nulls_last("page_or_index"), F.asc("block_id")
    )
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def resolve_by_name(files: DataFrame, requests) -> DataFrame:
    """Registered file for each loosely given name: equal, else containing, else the first file.

    ``files(file_name, pos)``; ``requests`` is a short Python list. Every file is read once
    and compared with the names inside its own row; only (request, tier, file) minima are
    shuffled, so no pair of tables is crossed.
    """
    names = list(dict.fromkeys(requests))
    name = F.col("file_name")

    def tier(r: Column) -> Column:
        either = (r != "") & (F.contains(name, r) | F.contains(r, name))
        return F.when((r != "") & (name == r), 1).when(either, 2).otherwise(3)

    scored = F.transform(strings(names), lambda r: record(request=r, tier=tier(r)))
    hits = files.select(name, "pos", F.explode(scored).alias("h")).select("h.request", "h.tier", "pos", name)
    best = hits.groupBy("request").agg(F.min(F.struct("tier", "pos", "file_name")).alias("m"))
    return best.select("request", "m.file_name", "m.pos", "m.tier")
