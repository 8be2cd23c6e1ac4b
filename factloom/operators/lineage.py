"""Where a fact came from and where it was used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def provenance_trace(facts: DataFrame, docs: DataFrame, blocks: DataFrame,
                     cells: DataFrame) -> DataFrame:
    """One row per fact and use: fact → document → block → filled cell (NULL when unused).

    Long form on purpose: a much used fact has as many rows as uses, never one huge array.
    """
    d = docs.select(F.col("doc_id").alias("source_doc_id"), "file_name")
    b = blocks.select(
        F.col("doc_id").alias("source_doc_id"), F.col("block_id").alias("source_block_id"),
        F.col("text").alias("block_text"), "block_type",
    )
    u = cells.select("fact_id", "task_id", "sheet_name", "cell_ref")
    return (
        facts.join(d, "source_doc_id", "left")
        .join(b, ["source_doc_id", "source_block_id"], "left")
        .join(u, "fact_id", "left")
    )


def with_evidence(facts: DataFrame, method: str, length: int = 200) -> DataFrame:
    """Extraction method and evidence text where they are missing from the metadata."""
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    extra = F.create_map(
        F.lit("extraction_method"), F.lit(method),
        F.lit("evidence_text"), F.left(F.coalesce("source_span", F.lit("")), F.lit(length)),
    )
    missing = F.map_filter(extra, lambda k, v: ~F.map_contains_key(old, k))
    return facts.withColumn("metadata", F.when(F.size(old) == 0, extra).otherwise(F.map_concat(old, missing)))
