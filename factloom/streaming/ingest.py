"""Incremental ingest: files arrive, become blocks and facts, and join the elected store.

The store is append-only per micro-batch: ``blocks/``, ``facts/``, ``winners/``, ``progress/`` and ``reviews/``, each with one
``batch_id=N`` folder that a retried batch overwrites. A document counts in its latest batch only, so one that arrives again
replaces what it said before, and a deleted one is a batch without content. Winners are partial elections of one batch each.
The current winners are a merge of the partial ones; only groups that lost a partial winner to a later batch, a review or a
deletion are elected anew, and nothing old is rewritten.

``compact`` writes a snapshot: under ``snapshots/upto=N`` the current state of every table up to batch N, without replaced and deleted
versions, and last of all a commit mark. Reads start from the newest snapshot with a mark and add the batches after it,
so they cost the same after a thousand batches as after one. ``expire`` deletes what no read needs any more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.canonical import GROUP, apply_latest_reviews, conflict_group_id, group_winners, in_groups, merge_winners
from factloom.operators.common import top_per_group
from factloom.operators.extraction import extract_facts, extract_text_facts
from factloom.operators.store import is_instruction
from factloom.session import BROADCAST_BYTES, materialised, small_side
from factloom.sources.blocks import text_blocks
from factloom.sources.office import file_blocks
from factloom.sources.vocabulary import Vocabulary

ID_BYTES = 256  # what a document id takes in a broadcast


@dataclass(frozen=True)
class Pipeline:
    """What a micro-batch goes through.

    ``to_ids``: documents to their ``doc_id`` (an id may come more than once); ``to_blocks``: documents to blocks, with one
    row carrying ``error`` for a document that cannot be read; ``to_facts``: blocks to facts.
    """

    to_ids: Callable[[DataFrame], DataFrame]
    to_blocks: Callable[[DataFrame], DataFrame]
    to_facts: Callable[[DataFrame], DataFrame]


def one_version(docs: DataFrame) -> DataFrame:
    """One row of each document of a batch: of several rows with an id the one that sorts last by text (null first), then file name.

    Only ids that come more than once are moved; without any the documents stay as they are.
    """
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again"))
    again = materialised(again, "ids-again")
    if again.isEmpty():
        return docs
    again = small_side(again, ID_BYTES)
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    settled = top_per_group(docs.join(again, same, "left_semi"), ["doc_id"], [F.desc("text"), F.desc("file_name")])
    return docs.join(again, same, "left_anti").unionByName(settled)


def text_pipeline(vocab: Vocabulary) -> Pipeline:
    """For documents (doc_id, text, file_name); an id that comes twice in a batch counts once (see ``one_version``)."""

    def blocks(docs: DataFrame) -> DataFrame:
        docs = one_version(docs)
        good = text_blocks(docs.where("text is not null"), keep=("file_name",))
        bad = docs.where("text is null").select(
            F.col("doc_id").cast("string").alias("doc_id"), "file_name", F.lit("no text").alias("error"))
        return good.unionByName(bad, allowMissingColumns=True)

    return Pipeline(
        lambda docs: docs.select(F.col("doc_id").cast("string").alias("doc_id")),
        # A plain text has no table rows, and each of its blocks comes once, so its facts are made distinct inside the block.
        blocks, lambda b: extract_text_facts(b, vocab, distinct=True),
    )


def file_pipeline(vocab: Vocabulary) -> Pipeline:
    """For files (path, content), as ``sources.office.arriving_files`` delivers them; the path is the document id.

    Instruction texts, told by their name or their first 2 048 bytes, are stored but not extracted from.
    """

    def facts(blocks: DataFrame) -> DataFrame:
        told = is_instruction(F.col("file_name"), F.coalesce("head", F.lit("")))
        return extract_facts(blocks.where(~told), vocab)

    return Pipeline(lambda files: files.select(F.col("path").alias("doc_id")), file_blocks, facts)


def _part(store: str, table: str, batch_id: int) -> str:
    return f"{store}/{table}/batch_id={batch_id}"


def document_counts(ids: DataFrame, blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """``(doc_id, status, block_count, fact_count)`` of each of the ``ids``; blocks of a document with an error do not count.

    All three tables meet in one grouping by document. A null id is a document whose blocks and facts are not told apart from others: it counts none.
    """
    number = lambda **n: [F.lit(n.get(c, 0)).alias(c) if isinstance(n.get(c, 0), int) else n[c].cast("int").alias(c)
                          for c in ("_here", "_bad", "_blocks", "_facts")]
    failed = F.col("error").isNotNull()
    rows = ids.select("doc_id", *number(_here=1)).unionByName(
        blocks.where("doc_id is not null").select("doc_id", *number(_bad=failed, _blocks=~failed))).unionByName(
        facts.where("source_doc_id is not null").select(F.col("source_doc_id").alias("doc_id"), *number(_facts=1)))
    sums = rows.groupBy("doc_id").agg(F.max("_here").alias("_here"), F.max("_bad").alias("_bad"), F.sum("_blocks").alias("_blocks"), F.sum("_facts").alias("_facts"))
    bad = F.col("_bad") == 1
    return sums.where("_here = 1").select(
        "doc_id", F.when(bad, "failed").otherwise("parsed").alias("status"),
        F.when(bad, F.lit(0)).otherwise(F.col("_blocks")).alias("block_count"), F.col("_facts").alias("fact_count"))


def write_batch(docs: DataFrame, batch_id: int, store: str, pipeline: Pipeline) -> None:
    """One micro-batch. Overwrites its own folders only, so a retry is harmless."""
    spark = docs.sparkSession
    started, clock = datetime.now(timezone.utc), perf_counter()
    # Written tables, not caches: each step reads back what the one before wrote, so nothing
    # is parsed twice and a lost executor costs no more than its own step.
    blocks = pipeline.to_blocks(docs)
    blocks.write.mode("overwrite").parquet(_part(store, "blocks", batch_id))
    written = spark.read.schema(blocks.schema).parquet(_part(store, "blocks", batch_id))
    bad = materialised(written.where("error is not null").select("doc_id").distinct(), "bad-documents")
    stored_blocks = written.where("error is null").join(small_side(bad, ID_BYTES), "doc_id", "left_anti")
    facts = pipeline.to_facts(stored_blocks)
    facts.write.mode("overwrite").parquet(_part(store, "facts", batch_id))
    stored = spark.read.schema(facts.schema).parquet(_part(store, "facts", batch_id))
    group_winners(stored).write.mode("overwrite").parquet(_part(store, "winners", batch_id))
    progress = document_counts(pipeline.to_ids(docs), written, stored).select(
        "doc_id", "status", "block_count", "fact_count",
        F.lit(started.isoformat()).alias("started_at"),
        F.lit(round(perf_counter() - clock, 3)).alias("batch_seconds"),
    )
    progress.write.mode("overwrite").parquet(_part(store, "progress", batch_id))


def ingest_stream(docs: DataFrame, store: str, checkpoint: str, pipeline: Pipeline,
                  available_now: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Run the ingest over a streaming DataFrame of what the pipeline takes."""
    writer = (
        docs.writeStream.foreachBatch(lambda df, n: write_batch(df, n, store, pipeline))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def write_reviews(reviews: DataFrame, batch_id: int, store: str) -> None:
    """Reviews ``(fact_id, status, reviewer, note, reviewed_at)`` as a batch of their own; they hold for facts stored up to it."""
    reviews.select("fact_id", "status", "reviewer", "note", "reviewed_at").write.mode("overwrite").parquet(_part(store, "reviews", batch_id))


def write_deletions(ids: DataFrame, batch_id: int, store: str) -> None:
    """Documents ``(doc_id)`` that are gone from this batch on."""
    ids.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("deleted").alias("status"), F.lit(0).cast("long").alias("block_count"),
        F.lit(0).cast("long").alias("fact_count"), F.lit(datetime.now(timezone.utc).isoformat()).alias("started_at"),
        F.lit(0.0).alias("batch_seconds"),
    ).distinct().write.mode("overwrite").parquet(_part(store, "progress", batch_id))


def next_batch(spark: SparkSession, store: str) -> int:
    """Number for a batch of reviews or deletions after all that the store holds."""
    last = snapshot(spark, store)
    for table in ("progress", "reviews"):
        if _there(spark, f"{store}/{table}"):
            last = max([last, *_batches(spark, f"{store}/{table}")])
    return last + 1


# --- snapshots -------------------------------------------------------------------------

TABLES = ("blocks", "facts", "winners", "progress", "reviews")


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``name=N`` folders below a path."""
    at, fs = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.split("=")[1]) for n in names if "=" in n)


def snapshot(spark: SparkSession, store: str) -> int:
    """Last batch of the newest snapshot that was written to its end; -1 where there is none."""
    done = [n for n in _batches(spark, f"{store}/snapshots") if _there(spark, f"{store}/snapshots/upto={n}/committed/_SUCCESS")]
    return max(done, default=-1)


def read_table(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    """A table of the store with ``batch_id``: the newest snapshot and the batches after it, whole ones only; None where there is nothing."""
    upto = snapshot(spark, store)
    known = set(_batches(spark, f"{store}/progress")) | set(_batches(spark, f"{store}/reviews"))
    parts = [n for n in _batches(spark, f"{store}/{table}") if n > upto and n in known]
    out = None
    if parts:
        out = spark.read.option("basePath", f"{store}/{table}").parquet(*[_part(store, table, n) for n in parts])
    base = f"{store}/snapshots/upto={upto}/{table}"
    if upto >= 0 and _there(spark, f"{base}/_SUCCESS"):
        held = spark.read.parquet(base)
        out = held if out is None else held.unionByName(out, allowMissingColumns=True)
    return out


def compact(spark: SparkSession, store: str, files: int = 8) -> int:
    """Write the state after all whole batches as a snapshot and return its number.

    Replaced and deleted versions of documents, reviews of facts that are gone and beaten partial winners are left behind; progress keeps every row. A
    batch that is still being written is not part of it (batches are written one after the other). Repeating an interrupted
    call writes the same folder again; readers see a snapshot only once it is whole.
    """
    begun = set(_batches(spark, f"{store}/blocks"))
    whole = set(_batches(spark, f"{store}/progress"))
    reviews = set(_batches(spark, f"{store}/reviews"))
    open_batches = begun - whole
    upto = max([n for n in whole | reviews if not open_batches or n < min(open_batches)], default=-1)
    if upto <= snapshot(spark, store):
        return snapshot(spark, store)
    base = f"{store}/snapshots/upto={upto}"
    state = {
        "blocks": read_table(spark, store, "blocks"), "facts": read_table(spark, store, "facts"), "progress": read_table(spark, store, "progress"),
        "reviews": read_table(spark, store, "reviews"), "winners": current_winners(spark, store).select(*group_winners_columns()),
    }
    moved = _moved(spark, store)
    if state["blocks"] is not None:
        state["blocks"] = _counting(state["blocks"].where("error is null"), moved, "doc_id")
    facts = state["facts"] = _counting(state["facts"], moved)
    if state["reviews"] is not None:
        state["reviews"] = _held(facts, state["reviews"])
    for table, rows in state.items():
        if rows is not None:
            rows.coalesce(files).write.mode("overwrite").parquet(f"{base}/{table}")
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{base}/committed")
    return upto


def expire(spark: SparkSession, store: str) -> None:
    """Delete the batch folders that the newest snapshot contains, and older snapshots. No reader may still be at work on them."""
    upto = snapshot(spark, store)
    if upto < 0:
        return
    gone = [_part(store, table, n) for table in TABLES for n in _batches(spark, f"{store}/{table}") if n <= upto]
    gone += [f"{store}/snapshots/upto={n}" for n in _batches(spark, f"{store}/snapshots") if n < upto]
    for path in gone:
        at, fs = _folder(spark, path)
        fs.delete(at, True)


def _there(spark: SparkSession, path: str) -> bool:
    at, fs = _folder(spark, path)
    return fs.exists(at)


@dataclass(frozen=True)
class Moved:
    """Documents that are in more than one batch, as a stored table ``(m_doc, m_batch)`` with the batch in which each counts; the last batch of all."""

    docs: DataFrame
    newest: int
    rows: int


def _moved(spark: SparkSession, store: str) -> Moved:
    docs = read_table(spark, store, "progress").where("doc_id is not null").groupBy(F.col("doc_id").alias("m_doc")).agg(
        F.max("batch_id").alias("m_batch"), F.min("batch_id").alias("_first")).where("_first < m_batch").select("m_doc", "m_batch")
    docs = materialised(docs, "moved-documents")
    newest = max([snapshot(spark, store), *_batches(spark, f"{store}/progress")])
    return Moved(docs, newest, docs.count())


def _older(rows: DataFrame, moved: Moved, how: str, doc: str) -> DataFrame:
    """Rows before the newest batch that a later one has (``leftsemi``) or has not (``leftanti``) replaced."""
    docs = F.broadcast(moved.docs) if moved.rows * ID_BYTES <= BROADCAST_BYTES else moved.docs
    return rows.where(F.col("batch_id") < moved.newest).join(docs, (F.col(doc) == F.col("m_doc")) & (F.col("batch_id") < F.col("m_batch")), how)


def _counting(rows: DataFrame, moved: Moved, doc: str = "source_doc_id") -> DataFrame:
    """Rows of documents in the batch in which they count. Nothing replaces what the newest batch says, so only older rows are looked up."""
    named = rows.where(F.col(doc).isNotNull())
    if not moved.rows:
        return named
    return named.where(F.col("batch_id") >= moved.newest).unionByName(_older(named, moved, "leftanti", doc))


def _replaced(rows: DataFrame, moved: Moved, doc: str = "source_doc_id") -> DataFrame:
    """The other rows."""
    return rows.where(F.col(doc).isNull()).unionByName(_older(rows, moved, "leftsemi", doc))


def current_blocks(spark: SparkSession, store: str) -> DataFrame:
    """Blocks of every document as it last arrived."""
    return _counting(read_table(spark, store, "blocks").where("error is null"), _moved(spark, store), "doc_id")


def stored_facts(spark: SparkSession, store: str, moved: Moved | None = None) -> DataFrame:
    """Facts of every document as it last arrived, with their latest review."""
    facts = _counting(read_table(spark, store, "facts"), moved or _moved(spark, store))
    reviews = read_table(spark, store, "reviews")
    return facts if reviews is None else apply_latest_reviews(facts, _held(facts, reviews))


def _held(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of facts as they are now: a fact that arrived again after its review is unreviewed."""
    now = facts.select(F.col("fact_id").alias("f_id"), F.col("batch_id").alias("f_batch"))
    return reviews.join(now, (F.col("fact_id") == F.col("f_id")) & (F.col("batch_id") >= F.col("f_batch")), "leftsemi")


def current_winners(spark: SparkSession, store: str, moved: Moved | None = None) -> DataFrame:
    """Elected fact per conflict group over all batches so far, with the batch of the fact."""
    partial = read_table(spark, store, "winners")
    moved = moved or _moved(spark, store)
    valid = _counting(partial, moved)
    facts = stored_facts(spark, store, moved)
    open_groups = _replaced(partial, moved).select(*GROUP)
    reviews = read_table(spark, store, "reviews")
    if reviews is not None:
        reviewed = reviews.select(F.col("fact_id").alias("r_id")).distinct()
        open_groups = open_groups.unionByName(facts.join(reviewed, F.col("fact_id") == F.col("r_id"), "leftsemi").select(*GROUP))
        open_groups = materialised(open_groups.distinct(), "open-groups")
        valid = in_groups(valid, open_groups, "leftanti")
    else:
        open_groups = materialised(open_groups.distinct(), "open-groups")
    again = in_groups(facts, open_groups, "leftsemi")
    return merge_winners(valid.select(*group_winners_columns()).unionByName(group_winners(again, ("batch_id",)).select(*group_winners_columns())))


def group_winners_columns() -> list[str]:
    return [*GROUP, "confidence", "has_number", "source_doc_id", "fact_id", "batch_id"]


def canonical_store(spark: SparkSession, store: str) -> DataFrame:
    """Current facts with their canonical flag."""
    moved = _moved(spark, store)
    won = materialised(current_winners(spark, store, moved).select("fact_id", F.lit(True).alias("_won")), "winners")
    return (
        stored_facts(spark, store, moved).join(small_side(won, ID_BYTES), "fact_id", "left")
        .withColumn("conflict_group_id", conflict_group_id())
        .withColumn("is_canonical", F.coalesce("_won", F.lit(False))).drop("_won", "batch_id")
    )


def progress_table(spark: SparkSession, store: str) -> DataFrame:
    """Status, counts and duration per document and batch."""
    return read_table(spark, store, "progress")
