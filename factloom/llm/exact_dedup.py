"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import small_side, stored

PREFIX = 256  # characters
ID, DIGEST = "__factloom_id", "__factloom_digest"  # helper columns beside a caller's own


def normalised(text: Column) -> Column:
    """Each run of space and \\x09-\\x0D becomes one space; null is empty. Runs that already are one space are left alone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)


def exact_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` that share their normalised text with another row.

    One row per (digest, doc_id): ``digest`` (sha256 hex), ``doc_id``, ``copies`` (rows with that id and text),
    ``keep_id`` (smallest id, nulls last) and ``group_size``. Lengths that occur once are out after the first step, prefixes
    that occur once after the second; only what survives both is hashed whole. Every step counts before
    it shuffles, and the lengths and prefixes that occur again are sent to the rows where they fit a broadcast, so a length, prefix or
    text shared by a third of the rows is no hot key; beyond that size the rows are joined by a shuffle whose skewed keys Spark splits.
    """
    text = normalised(F.col("text"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body")).select(
        "doc_id", F.octet_length("body").alias("bytes"), F.xxhash64(F.substring("body", 1, prefix)).alias("head"))
    sized = stored(sized, "sizes")
    by_length = small_side(stored(_repeated(sized, "bytes"), "lengths"), 16)
    survivors = stored(_repeated(sized.join(by_length, "bytes", "leftsemi"), "bytes", "head"), "survivors")
    ids = stored(sized.join(small_side(survivors, 32), ["bytes", "head"], "leftsemi").select("doc_id").distinct(), "ids")
    ids = small_side(ids.select(F.col("doc_id").alias(ID)), 32)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = whole.join(ids, F.col("doc_id").eqNullSafe(F.col(ID)), "leftsemi")
    hashed = whole.groupBy(F.sha2(text.cast("binary"), 256).alias("digest"), "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    hashed = stored(hashed, "digests")
    groups = hashed.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")).where("group_size > 1")
    return hashed.join(small_side(stored(groups, "digest-groups"), 128), "digest")


def exact_dedup(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """``docs`` without the rows whose normalised text another row has that comes first; all columns stay as they are.

    Of equal texts the row with the smallest doc_id stays; of rows that repeat id and text, one stays.
    """
    groups = stored(exact_groups(docs, prefix), "groups")
    named = groups.select(F.col("doc_id").alias(ID), F.col("digest").alias(DIGEST), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("first"), "copies")
    lost = small_side(named.where("not first").drop("first", "copies"), 128)
    same = F.col("doc_id").eqNullSafe(F.col(ID))
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256) == F.col(DIGEST)
    kept = docs.join(lost, same & digest, "leftanti")
    again = named.where("first and copies > 1").drop("first", "copies")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, same & digest, "leftsemi")
    repeated = repeated.withColumn(DIGEST, F.sha2(normalised(F.col("text")).cast("binary"), 256)).dropDuplicates(["doc_id", DIGEST])
    return kept.join(again, same & digest, "leftanti").unionByName(repeated.select(docs.columns))


def dedup_report(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs(doc_id, text)``.

    Groups come from ``exact_groups``; a row that no other shares its text with is a group of one. Null counts as
    empty, so all null and blank-free empty texts are one group. Of rows that repeat id and text one is kept.
    """
    groups = stored(exact_groups(docs, prefix), "groups").select(
        F.col("digest").alias(DIGEST), F.col("doc_id").alias(ID), "keep_id", "group_size")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    rows = rows.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    found = rows.join(groups, (F.col("text_sha256") == F.col(DIGEST)) & F.col("doc_id").eqNullSafe(F.col(ID)), "left")
    alone = F.col(DIGEST).isNull()
    return found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        ((F.col("copy") == 1) & (alone | F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"), "text_sha256")
