"""Filters over facts, documents, blocks and structured rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import dates
from factloom.functions import fixed_values as fv
from factloom.functions.text import as_col, strings, strip, strip_one_suffix

FACT_ORDER = (F.desc, "confidence"), (F.asc, "fact_id")


def fact_order() -> list[Column]:
    return [fn(name) for fn, name in FACT_ORDER]


def facts_query(facts: DataFrame, entity: str | None = None, field: str | None = None,
                status: str | None = None, min_confidence: float | None = None,
                canonical_only: bool = False, documents=None) -> DataFrame:
    """Facts by predicate; an empty document set gives an empty result.

    ``documents`` is a list of ids or a DataFrame with ``doc_id``. Order the result by
    ``fact_order()`` where it is shown.
    """
    out = facts
    if canonical_only:
        out = out.where("is_canonical")
    if entity is not None:
        out = out.where(F.col("entity_name") == entity)
    if field is not None:
        out = out.where(F.col("field_name") == field)
    if status is not None:
        out = out.where(F.col("status") == status)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if isinstance(documents, DataFrame):
        ids = documents.select(F.col("doc_id").alias("source_doc_id"))
        out = out.join(ids, "source_doc_id", "left_semi")
    elif documents is not None:
        ids = list(documents)
        out = out.where(F.col("source_doc_id").isin(*ids) if ids else F.lit(False))
    return out


def search_facts(facts: DataFrame, entity: str | None = None, field: str | None = None,
                 year: int | None = None, min_confidence: float | None = None,
                 limit: int = 20) -> DataFrame:
    """Top canonical facts, best first."""
    out = facts_query(facts, entity, field, min_confidence=min_confidence, canonical_only=True)
    if year is not None:
        out = out.where(F.col("year") == year)
    return out.orderBy(*fact_order()).limit(limit)


def low_confidence(facts: DataFrame, threshold: float = 0.7) -> DataFrame:
    return facts.where(F.col("is_canonical") & (F.col("confidence") < threshold))


def list_documents(docs: DataFrame, status: str | None = None, name: str | None = None,
                   newest_first: str | None = None) -> DataFrame:
    """Documents by status and by part of their name, case-insensitively; in the order of an upload time where one is named."""
    out = docs if status is None else docs.where(F.col("status") == status)
    if name:
        out = out.where(F.contains(F.lower("file_name"), F.lit(name.lower())))
    return out if newest_first is None else out.orderBy(F.desc(newest_first), F.asc("doc_id"))


def filter_by_date(facts: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """Facts dated inside the range; facts without a date are kept."""
    return facts.where(dates.within(F.col("metadata")["date"], lo, hi))


def intent_filter(facts: DataFrame, date_from: str | None = None, date_to: str | None = None,
                  entities=()) -> DataFrame:
    """Date check on the metadata date, else on the year; then the entity check."""
    date, year = F.col("metadata")["date"], F.col("year")
    year_ok = F.lit(True)
    if date_from:
        year_ok = year_ok & (year >= int(date_from[:4]))
    if date_to:
        year_ok = year_ok & (year <= int(date_to[:4]))
    ok = (
        F.when(date.isNotNull() & (date != ""), dates.within(date, date_from, date_to))
        .when(year.isNotNull(), year_ok)
        .otherwise(True)
    )
    out = facts.where(ok)
    wanted = [e.lower() for e in entities]
    if wanted:
        name = strip_one_suffix("entity_name")
        partial = F.exists(
            strings(wanted), lambda t: F.contains(name, t) | F.contains(t, name)
        )
        out = out.where((name == "") | name.isin(*wanted) | partial)
    return out


def filter_rows_by_date(rows: DataFrame, time_col: Column | str, lo: str | None,
                        hi: str | None) -> DataFrame:
    """Rows whose raw time cell is in the range; blank or unreadable cells are kept."""
    return rows.where(dates.within(dates.row_date(as_col(time_col)), lo, hi))


def nearest_hour(rows: DataFrame, time_text: Column | str, date: str, hour: int | None) -> DataFrame:
    """All rows of the date at the smallest distance from the hour.

    Rows without an hour count only when no row has one; without any row of the date the
    input comes back unchanged.
    """
    text = as_col(time_text)
    on_date = F.coalesce(F.contains(text, F.lit(date)), F.lit(False))
    marked = rows.withColumn("_on", on_date)
    if hour is None:
        marked = marked.withColumn("_delta", F.lit(None).cast("int"))
    else:
        marked = marked.withColumn("_delta", F.when(on_date, F.abs(dates.hour_of(text) - hour)))
    any_row = marked.agg(F.coalesce(F.bool_or("_on"), F.lit(False))).scalar()
    best = marked.agg(F.min("_delta")).scalar()
    keep = F.when(~any_row, True).otherwise(
        F.col("_on") & F.coalesce(F.col("_delta") == best, best.isNull())
    )
    return marked.where(keep).drop("_on", "_delta")


def nearest_hour_targets(rows: DataFrame, time_text: str, targets: DataFrame,
                         keys=()) -> DataFrame:
    """Nearest-hour rows for many targets ``(target, date, hour, *keys)`` at once.

    The hours that occur are few per date and keys, so a target first chooses among those; its rows are then joined on date, keys
    and the chosen hours. No row meets a target whose hours it has not. Targets without a row of their date give nothing.
    """
    text = F.col(time_text)
    dated = rows.withColumn("date", dates.iso_of(text)).withColumn("_hour", dates.hour_of(text))
    hours = dated.select("date", *keys, "_hour").distinct()
    pairs = hours.join(targets, ["date", *keys]).withColumn("_delta", F.abs(F.col("_hour") - F.col("hour")))
    rank = F.dense_rank().over(Window.partitionBy("target").orderBy(F.asc_nulls_last("_delta")))
    chosen = pairs.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_delta").withColumnRenamed("_hour", "_near")
    for k in ["date", *keys]:
        chosen = chosen.withColumnRenamed(k, f"_t_{k}")
    same = F.col("_hour").eqNullSafe(F.col("_near"))
    for k in ["date", *keys]:
        same = same & (F.col(k) == F.col(f"_t_{k}"))
    return dated.join(chosen, same).drop("_hour", "_near", *[f"_t_{k}" for k in ["date", *keys]])


def query_rows(rows: DataFrame, entity_col: str | None, entity: str | None, time_col: str | None,
               date: str | None, hour: int | None, all_cols=()) -> DataFrame:
    """Rows whose entity cell contains the target and whose time cell contains the date."""
    out = rows
    if entity and entity_col:
        out = out.where(F.contains(F.col(entity_col), F.lit(entity)))
    if date:
        cols = [time_col] if time_col else list(all_cols or rows.columns)
        out = out.where(
            F.exists(
                F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]),
                lambda v: F.contains(v, F.lit(date)),
            )
        )
    if hour is not None and time_col:
        out = out.withColumn("_delta", F.abs(dates.hour_of(time_col) - hour))
        best = out.agg(F.min("_delta")).scalar()
        out = out.where(F.coalesce(F.col("_delta") == best, best.isNull())).drop("_delta")
    return out


def prefilter_blocks(blocks: DataFrame, entities) -> DataFrame:
    """Headings, and blocks whose text contains any target entity."""
    if not entities:
        return blocks
    hit = F.exists(strings(entities), lambda e: F.contains(F.coalesce("text", F.lit("")), e))
    return blocks.where((F.col("block_type") == "heading") | hit)


def drop_aggregates(df: DataFrame, entity_col: str, names=fv.AGGREGATE_NAMES) -> DataFrame:
    """Without total and average pseudo-entities."""
    return df.where(~F.coalesce(strip(entity_col), F.lit("")).isin(*names))


def rows_at(df: DataFrame, entity_col: str, time_col: str, targets: DataFrame) -> DataFrame:
    """Rows of many (target, entity, at) at one exact time each; one result set per target.

    The exact time is the join key; the entity containment is checked on the matches.
    """
    t = targets.select("target", F.col("entity").alias("_entity"), F.col("at").alias("_at"))
    joined = df.join(t, F.col(time_col) == F.col("_at"))
    return joined.where(F.contains(F.col(entity_col), F.col("_entity"))).drop("_entity", "_at")


def to_template_schema(df: DataFrame, columns, mapping: dict[str, str] | None = None) -> DataFrame:
    """Template columns in template order; renamed by mapping, missing ones NULL."""
    source = {target: src for src, target in (mapping or {}).items()}
    have = set(df.columns)
    picks = []
    for column in columns:
        src = source.get(column, column)
        picks.append(F.col(f"`{src}`").alias(column) if src in have
                     else F.lit(None).cast("string").alias(column))
    return df.select(*picks)


def resolve_documents(docs: DataFrame, set_id: str | None = None, ids=None) -> DataFrame:
    """Document scope: explicit ids, else the set, else a comma list of ids, else all.

    Only parsed documents that are not flagged to be skipped are ever in scope.
    """
    parsed = docs.where((F.col("status") == "parsed") & ~F.coalesce("skip_extraction", F.lit(False)))
    if ids:
        return parsed.where(F.col("doc_id").isin(*ids))
    if not set_id or set_id in ("default", "all"):
        return parsed
    listed = [part.strip() for part in set_id.split(",") if part.strip()]
    staged = parsed.withColumn(
        "_stage",
        F.when(F.trim(F.coalesce("document_set_id", F.lit(""))) == set_id, 1).when(
            F.col("doc_id").isin(*listed) if listed else F.lit(False), 2
        ),
    ).where(F.col("_stage").isNotNull())
    first = staged.agg(F.min("_stage")).scalar()
    return staged.where(F.col("_stage") == first).drop("_stage")
