"""Cleaning, reshaping and rolling up tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import fixed_values as fv
from factloom.functions import text
from factloom.functions.text import strip
from factloom.operators.common import top_per_group


def unique_names(names) -> list[str]:
    """Repeated column names get _1, _2 … in order."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, -1) + 1
        out.append(name if seen[name] == 0 else f"{name}_{seen[name]}")
    return out


def is_date_name(name: str) -> bool:
    return any(hint in name.lower() for hint in fv.DATE_COLUMN_HINTS)


def basic_clean(df: DataFrame) -> DataFrame:
    """Unique names, no all-null rows, whole-column number coercion, day numbers to ISO dates.

    One aggregate over the data decides per column (a single row comes to the driver, since
    the output schema depends on it); the rewrite is one projection.
    """
    df = df.toDF(*unique_names(df.columns)).dropna("all")
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    as_number = {c: strip(F.col(f"`{c}`")).try_cast("double") for c in texts}
    checks = []
    for i, c in enumerate(df.columns):
        value = as_number.get(c, F.col(f"`{c}`") if c in numeric else F.lit(None).cast("double"))
        checks += [
            F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.count(value).alias(f"k{i}"),
            F.min(value.cast("double")).alias(f"lo{i}"), F.max(value.cast("double")).alias(f"hi{i}"),
            F.coalesce(F.bool_and(value.cast("double") == F.floor(value.cast("double"))), F.lit(False)).alias(f"w{i}"),
        ]
    seen = df.agg(*checks).first()
    picks = []
    for i, c in enumerate(df.columns):
        number = c in numeric or (c in texts and seen[f"n{i}"] and seen[f"n{i}"] == seen[f"k{i}"])
        col = as_number[c] if number and c in texts else F.col(f"`{c}`")
        if number and is_date_name(c) and seen[f"n{i}"] and seen[f"lo{i}"] > 30000 and seen[f"hi{i}"] < 55000:
            col = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(col).cast("int")).cast("string")
        elif number and c in texts and seen[f"w{i}"] and max(abs(seen[f"lo{i}"]), abs(seen[f"hi{i}"])) < 2**53:
            col = col.cast("long")
        picks.append(col.alias(c))
    return df.select(*picks)


def clean_entity(df: DataFrame, **rules) -> DataFrame:
    """Entity columns (by name hint) cut to their leading entity name."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    hit = lambda c: any(h in c or h in c.lower() for h in fv.ENTITY_COLUMN_HINTS)
    return df.select(*[
        text.clean_entity_value(F.col(f"`{c}`"), **rules).alias(c) if c in strings and hit(c)
        else F.col(f"`{c}`") for c in df.columns
    ])


def rollup_kind(name: str, numeric: bool) -> str:
    low = name.lower()
    if (any(h in name for h in fv.MEAN_HINTS) or any(h in low for h in fv.MEAN_HINTS_LOWER)
            or name.endswith(fv.MEAN_SUFFIX)):
        return "mean"
    if any(h in name for h in fv.FIRST_HINTS):
        return "first"
    return "sum" if numeric else "first"


def rollup_by_name(df: DataFrame, keys, order: Column, policy=rollup_kind) -> DataFrame:
    """Group by entity with one aggregate per column, picked from the column name.

    ``first`` means the first non-null value in ``order``, so results do not depend on how
    the table is partitioned.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    aggs = []
    for f in df.schema.fields:
        if f.name in keys:
            continue
        c = F.col(f"`{f.name}`")
        kind = policy(f.name, isinstance(f.dataType, T.NumericType))
        if kind == "mean":
            aggs.append(F.avg(c.cast("double")).alias(f.name))
        elif kind == "sum":
            aggs.append(F.sum(c).alias(f.name))
        else:
            aggs.append(F.min_by(c, F.when(c.isNotNull(), order)).alias(f.name))
    return df.groupBy(*keys).agg(*aggs)


def rollup_to_parent(df: DataFrame, entity: str, parents: DataFrame, order: str,
                     policy=rollup_kind) -> DataFrame:
    """Child entities replaced by their parent (``parents(child, parent)``), then rolled up."""
    mapped = df.where(F.col(entity).isNotNull()).join(parents, F.col(entity) == F.col("child"), "left")
    replaced = mapped.withColumn(entity, F.coalesce("parent", entity)).drop("child", "parent")
    out = rollup_by_name(replaced, entity, F.col(order), policy)
    return out.drop(order)


def rollup_range(df: DataFrame, date: str, lo: str, hi: str, keys, order: Column,
                 policy=rollup_kind) -> DataFrame:
    """Rows of a date range rolled up per entity, for templates without a date column."""
    inside = df.where((F.col(date) >= lo) & (F.col(date) <= hi)).drop(date)
    return rollup_by_name(inside, keys, order, policy)


def union_sources(sources) -> DataFrame:
    """Differently shaped sources under one schema; missing columns are NULL."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source, allowMissingColumns=True)
    return out


def enrich(main: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """All rows of the main source with the columns of an extra one; a key that the extra one repeats gives a row for each (see ``last_record``)."""
    return main.join(extra, key, "left")


def last_record(records: DataFrame, key: str, pos: str) -> DataFrame:
    """Last record per key."""
    return top_per_group(records, [key], [F.desc(pos)])


def fill_from_records(template: DataFrame, records: DataFrame, entity: str, pos: str,
                      suffix: str = fv.CITY_SUFFIX) -> DataFrame:
    """Template entities with the last record of each, names compared without the suffix."""
    bare = lambda c: F.regexp_replace(strip(c), f"{suffix}$", "")
    keyed = records.withColumn("_key", bare(entity)).where("_key <> ''")
    last = last_record(keyed, "_key", pos).drop(entity, pos)
    return template.withColumn("_key", bare(entity)).join(last, "_key", "left").drop("_key")


def entity_pivot(facts: DataFrame, fields, pos: str = "pos") -> DataFrame:
    """One wide row per entity for an explicit field list; the last value of a field wins."""
    value = F.coalesce(F.col("value_num").cast("string"), F.col("value_text"))
    named = facts.select(
        F.coalesce(text.none_if_empty(F.col("entity_name")), F.lit("_unknown_")).alias("entity"),
        "field_name", value.alias("v"), pos,
    )
    return named.groupBy("entity").pivot("field_name", list(fields)).agg(F.max_by("v", pos))


def row_groups(facts: DataFrame, pos: str = "pos") -> DataFrame:
    """Facts per source block as a field → value map; the last fact of a field wins.

    Pre-aggregated per (block, field), so the map has one entry per field.
    """
    value = F.coalesce(F.col("value_num").cast("string"), F.col("value_text"))
    per_field = facts.groupBy("source_block_id", "field_name").agg(
        F.max_by(F.struct("fact_id", value.alias("value")), pos).alias("f"),
        F.max(F.when(F.col("entity_name") != "", F.struct(pos, "entity_name"))).alias("e"),
    )
    return per_field.groupBy("source_block_id").agg(
        F.max("e")["entity_name"].alias("entity_name"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("field_name", F.col("f.value"))))
        ).alias("field_values"),
    )


def unique_entities(facts: DataFrame, fields=None, pos: str = "pos") -> DataFrame:
    """Entities in first-appearance order, without aggregates; optionally with a wanted field."""
    rows = facts.where("entity_name is not null and entity_name <> ''").where(
        ~strip("entity_name").isin(*fv.AGGREGATE_NAMES)
    )
    has = F.lit(True) if fields is None else F.col("field_name").isin(*fields)
    return (
        rows.groupBy("entity_name")
        .agg(F.min(pos).alias("first_pos"), F.bool_or(has).alias("_has"))
        .where("_has").drop("_has")
    )


def set_algebra(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Intersection or difference of two one-column sets."""
    return {"intersect": a.intersect, "subtract": a.subtract}[how](b)
