"""Election of one canonical fact per conflict group: in full, and as a log of changed flags for inserts, reviews and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import record
from factloom.operators.common import top_per_group
from factloom.session import materialised, small_side

GROUP = ("entity_type", "entity_name", "field_name", "year", "unit")


def conflict_group_id() -> Column:
    return F.concat_ws("::", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in GROUP])


def group_winners(facts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The elected fact of each conflict group: (group keys, ranking columns, fact_id, ``keep``).

    Best by confidence, having a number, source document and fact id, all descending.
    A group limit before the shuffle leaves one candidate per task and group, and winners
    of winners are winners, so partial elections can be merged (see ``streaming``).
    """
    cols = [*GROUP, "confidence", F.col("value_num").isNotNull().alias("has_number"),
            "source_doc_id", "fact_id", *keep]
    open_facts = facts.where(F.coalesce(F.col("status"), F.lit("")) != "rejected").select(*cols)
    return merge_winners(open_facts)


def merge_winners(winners: DataFrame) -> DataFrame:
    order = [F.desc(c) for c in ("confidence", "has_number", "source_doc_id", "fact_id")]
    return top_per_group(winners, GROUP, order)


def elect_canonical(facts: DataFrame) -> DataFrame:
    """Facts with ``conflict_group_id`` and ``is_canonical``.

    The flag comes back through a join on the unique fact id, so a conflict group that
    holds most of the table never meets in one task.
    """
    winners = group_winners(facts).select("fact_id", F.lit(True).alias("_won"))
    base = facts.drop("is_canonical", "conflict_group_id")
    return (
        base.join(winners, "fact_id", "left")
        .withColumn("conflict_group_id", conflict_group_id())
        .withColumn("is_canonical", F.coalesce("_won", F.lit(False)))
        .drop("_won")
    )


# --- changes ---------------------------------------------------------------------------
# An elected table holds one winner per conflict group, so a change is settled between winners: what comes in plays against the
# winner of its group, and only a group whose own winner goes is elected again. The outcome is a log of the flags that change
# (fact_id, is_canonical), which is joined to the facts by their unique id; facts are never shuffled by group.

RANK = ("confidence", "has_number", "source_doc_id", "fact_id")
GROUP_BYTES = 256  # what a group's keys take in a broadcast


def _ranked(facts: DataFrame) -> list:
    return [*GROUP, "confidence", F.col("value_num").isNotNull().alias("has_number"), "source_doc_id", "fact_id"]


def in_groups(facts: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """Facts whose conflict group is (``leftsemi``) or is not (``leftanti``) in a stored table of groups; sent to the facts where it is small."""
    named = small_side(groups.select(*[F.col(c).alias(f"g_{c}") for c in GROUP]).distinct(), GROUP_BYTES)
    same = F.lit(True)
    for c in GROUP:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return facts.join(named, same, how)


def flips(rows: DataFrame, on: bool, fact_id: str = "fact_id") -> DataFrame:
    return rows.where(F.col(fact_id).isNotNull()).select(F.col(fact_id).alias("fact_id"), F.lit(on).alias("flag"))


def insert_flips(store: DataFrame, new: DataFrame) -> DataFrame:
    """Flags that change when ``new`` facts come to an elected ``store``: their winners that beat the store's, and those beaten."""
    rank = F.struct(*RANK)
    fresh = group_winners(new).select(*[F.col(c).alias(f"f_{c}") for c in GROUP], F.col("fact_id").alias("won"), rank.alias("_new"))
    now = store.where("is_canonical").select(*_ranked(store)).select(*GROUP, F.col("fact_id").alias("lost"), rank.alias("_old"))
    same = F.lit(True)
    for c in GROUP:
        same = same & F.col(f"f_{c}").eqNullSafe(F.col(c))
    duels = fresh.join(now, same, "left").where(F.col("_old").isNull() | (F.col("_new") > F.col("_old"))).select("won", "lost")
    duels = materialised(duels, "duels")
    return flips(duels, True, "won").unionByName(flips(duels, False, "lost"))


def with_flips(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """Elected facts with a log of changed flags applied."""
    log = changed.select(F.col("fact_id").alias("_changed"), "flag")
    return facts.join(log, F.col("fact_id") == F.col("_changed"), "left").withColumn(
        "is_canonical", F.coalesce("flag", "is_canonical")).drop("_changed", "flag")


def elect_affected(store: DataFrame, new: DataFrame) -> DataFrame:
    """An elected ``store`` with new facts added; flags change in the groups they win."""
    added = new.withColumn("conflict_group_id", conflict_group_id()).withColumn("is_canonical", F.lit(False))
    return with_flips(store.unionByName(added, allowMissingColumns=True), insert_flips(store, new))


def reviewed_flips(facts: DataFrame, latest: DataFrame) -> DataFrame:
    """Flags that change when elected ``facts`` get their ``latest`` reviews, one a fact.

    A rejected winner vacates its group, which is elected again; a fact that is no longer rejected plays against the winner of its group.
    """
    last = latest.select("fact_id", F.trim("status").alias("_status"))
    rejected = lambda c: F.coalesce(F.col(c), F.lit("")) == "rejected"
    after = F.coalesce("_status", "status").alias("status")
    touched = facts.join(last, "fact_id").select(
        *GROUP, "confidence", "value_num", "source_doc_id", "fact_id", "is_canonical", after, rejected("status").alias("_was"))
    touched = materialised(touched.where(rejected("status") != F.col("_was")), "reviewed")
    toppled = touched.where(F.col("is_canonical") & rejected("status"))
    opened = touched.where("_was")
    vacated = materialised(toppled.select(*GROUP).distinct(), "vacated")
    changed = flips(toppled, False).unionByName(insert_flips(facts, in_groups(opened, vacated, "leftanti")))
    if vacated.isEmpty():
        return changed
    narrow = facts.join(last, "fact_id", "left").select(*GROUP, "confidence", "value_num", "source_doc_id", "fact_id", after)
    return changed.unionByName(flips(group_winners(in_groups(narrow, vacated, "leftsemi")), True))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each fact."""
    return top_per_group(reviews, ["fact_id"], [F.desc("reviewed_at"), F.desc("status")])


def apply_latest_reviews(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Facts with status and metadata of their latest review; canonical flags are left to the caller.

    ``reviews(fact_id, status, reviewer, note, reviewed_at string)``.
    """
    return _with_latest(facts, latest_reviews(reviews))


def _with_latest(facts: DataFrame, last: DataFrame) -> DataFrame:
    notes = F.filter(
        F.array(
            *[
                record(key=F.lit(key), value=F.trim(F.col(col)))
                for key, col in (
                    ("reviewed_at", "reviewed_at"), ("reviewer", "reviewer"), ("review_note", "note")
                )
            ]
        ),
        lambda e: e["value"].isNotNull() & (e["value"] != ""),
    )
    updates = last.select(
        "fact_id", F.trim("status").alias("_status"), F.map_from_entries(notes).alias("_notes")
    )
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(F.col("_notes"), k))
    return (
        facts.join(updates, "fact_id", "left")
        .withColumn("metadata", F.when(F.col("_notes").isNull(), F.col("metadata"))
                    .otherwise(F.map_concat(kept, F.col("_notes"))))
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status", "_notes")
    )


def apply_reviews(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """All facts with their latest review; where they are elected already, only flags that the reviews change do."""
    if "is_canonical" not in facts.columns:
        return elect_canonical(apply_latest_reviews(facts, reviews))
    last = materialised(latest_reviews(reviews), "latest-reviews")
    return with_flips(_with_latest(facts, last), reviewed_flips(facts, last))


def delete_documents(docs: DataFrame, blocks: DataFrame, facts: DataFrame, ids: DataFrame):
    """Drop documents with their blocks and elected facts; a group whose winner went is elected again."""
    gone = ids.select("doc_id").distinct()
    fact_key = gone.withColumnRenamed("doc_id", "source_doc_id")
    left = facts.join(fact_key, "source_doc_id", "left_anti").select(*facts.columns)
    vacated = materialised(facts.where("is_canonical").join(fact_key, "source_doc_id", "left_semi").select(*GROUP).distinct(), "vacated")
    again = group_winners(in_groups(left, vacated, "leftsemi"))
    return (
        docs.join(gone, "doc_id", "left_anti"),
        blocks.join(gone, "doc_id", "left_anti"),
        with_flips(left, flips(again, True)),
    )
