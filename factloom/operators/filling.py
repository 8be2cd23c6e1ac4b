"""Layout of templates and filling of their cells. Cells are long: one row per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed_values as fv
from factloom.functions import numbers, text
from factloom.functions.text import strip
from factloom.operators.common import rank_by_position, top_per_group
from factloom.operators.extraction import canonicalize_headers
from factloom.session import materialised, parameter_table, small_side
from factloom.sources.vocabulary import Vocabulary

SHEET = ("template", "sheet")
SHEET_BYTES = 256  # what a row about a sheet takes in a broadcast


def per_sheet(side: DataFrame) -> DataFrame:
    """A table with a few rows per sheet as the side of a join: sent to the rows where it is small, so that a sheet with most rows is no hot key.

    Beyond that size the rows are shuffled by sheet, and Spark splits the skewed ones.
    """
    return small_side(side, SHEET_BYTES)


def detect_layout(cells: DataFrame, vocab: Vocabulary, known_fields: DataFrame | None = None,
                  max_row: int = 10) -> tuple[DataFrame, DataFrame]:
    """(layout, field columns) of each sheet.

    A header row scores 3 per entity header and 2 per known field; it needs one field, the
    earliest best row wins, and without an entity header the first column is the entity column.
    """
    head = cells.where((F.col("row") <= max_row) & (F.coalesce("value", F.lit("")) != ""))
    named = canonicalize_headers(head, "value", vocab)
    if known_fields is not None:
        known = known_fields.select(F.lower("field").alias("_kl"), F.col("field").alias("_kf")).groupBy("_kl").agg(
            F.min("_kf").alias("_kf"), F.collect_set("_kf").alias("_all"))
        named = named.withColumn("_stripped", text.normalize_header("value")).join(
            known, F.lower("_stripped") == F.col("_kl"), "left")
        exact = F.array_contains("_all", F.col("_stripped"))
        found = F.when(F.col("is_canonical_field"), F.col("field")).when(exact, F.col("_stripped")).otherwise(F.col("_kf"))
    else:
        found = F.when(F.col("is_canonical_field"), F.col("field"))
    scored = named.select(
        *SHEET, "row", "col", found.alias("field"),
        text.is_entity_header("value", vocab.entity_headers).alias("_ent"),
    )
    rows = scored.groupBy(*SHEET, "row").agg(
        (3 * F.count_if("_ent") + 2 * F.count("field")).alias("score"),
        F.count("field").alias("_n"),
        F.max(F.when(F.col("_ent"), F.col("col"))).alias("_ec"),
    ).where("_n > 0")
    layout = top_per_group(rows, SHEET, [F.desc("score"), F.asc("row")]).select(
        *SHEET, "row", F.coalesce("_ec", F.lit(1)).alias("entity_col"), "score"
    )
    columns = scored.where("field is not null").join(layout, [*SHEET, "row"]).select(*SHEET, "col", "field")
    return layout, columns


def data_rows(cells: DataFrame, layout: DataFrame, vocab_suffixes=fv.ENTITY_SUFFIXES) -> DataFrame:
    """Rows below the header with their raw and normalised entity ('' when blank)."""
    h = layout.select(*SHEET, F.col("row").alias("_h"), "entity_col")
    below = cells.join(per_sheet(h), list(SHEET)).where(F.col("row") > F.col("_h"))
    raw = F.max(F.when(F.col("col") == F.col("entity_col"), F.col("value")))
    rows = below.groupBy(*SHEET, "row").agg(
        F.coalesce(raw, F.lit("")).alias("raw_entity"),
        F.bool_or(strip(F.coalesce("value", F.lit(""))) != "").alias("has_text"),
    )
    return rows.withColumn("entity", text.normalize_entity("raw_entity", vocab_suffixes))


def fact_lookup(facts: DataFrame, suffix: str | None = fv.CITY_SUFFIX) -> DataFrame:
    """Best fact per (entity key, field); a fact also answers to its name with / without the suffix."""
    cols = ("fact_id", "entity_name", "value_num", "value_text", "confidence", "source_span")
    keys = [F.col("entity_name")]
    if suffix:
        name = F.col("entity_name")
        alt = F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(
            F.concat(name, F.lit(suffix)))
        keys.append(F.when(name != "", alt))
    keyed = facts.select(
        F.explode(F.array_compact(F.array(*keys))).alias("entity_key"), "field_name", *cols
    )
    return top_per_group(keyed, ["entity_key", "field_name"], [F.desc("confidence"), F.asc("fact_id")])


FACT_COLS = ("fact_id", "value_num", "value_text", "confidence", "source_span")


def look_up(targets: DataFrame, lookup: DataFrame, entity: str, raw_entity: str | None = None,
            field: str = "field", key=(*SHEET, "row", "col")) -> DataFrame:
    """Best fact by normalised name, then by raw name; targets without a fact are dropped.

    Both names of a target go into one join; ``key`` tells targets apart where they have two names.
    """
    found = lookup.select(F.col("entity_key").alias("_k"), F.col("field_name").alias("_f"), *[F.col(c).alias(f"_v_{c}") for c in FACT_COLS])
    if raw_entity:
        names = F.array_distinct(F.array(F.col(entity), F.col(raw_entity)))
        asked = targets.select("*", F.posexplode(names).alias("_tier", "_name"))
    else:
        asked = targets.withColumns({"_tier": F.lit(0), "_name": F.col(entity)})
    met = asked.join(found, (F.col("_name") == F.col("_k")) & (F.col(field) == F.col("_f")))
    if raw_entity:
        met = top_per_group(met, list(key), [F.asc("_tier")])
    return met.select(*targets.columns, *[F.col(f"_v_{c}").alias(c) for c in FACT_COLS])


def as_cells(filled: DataFrame, task_id: str, field: str = "field", evidence: int = 200) -> DataFrame:
    """Filled-cell records: number or text value, address, fact, confidence, evidence."""
    num = F.col("value_num")
    shown = F.when(num == F.floor(num), num).otherwise(F.round(num, 4))
    return filled.select(
        F.lit(task_id).alias("task_id"), "template", F.col("sheet").alias("sheet_name"), "row", "col",
        numbers.cell_ref(F.col("row"), F.col("col")).alias("cell_ref"),
        F.col("entity").alias("entity_name"), F.col(field).alias("field_name"),
        shown.alias("value_num"), F.when(num.isNull(), F.col("value_text")).alias("value_text"),
        "fact_id", "confidence", F.left(F.coalesce("source_span", F.lit("")), F.lit(evidence)).alias("evidence_text"),
    )


def fill_by_entity(rows: DataFrame, columns: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows that already name an entity × mapped columns, with the best fact of each."""
    named = rows.where(strip("raw_entity") != "").join(per_sheet(columns), list(SHEET))
    named = named.withColumn("entity", F.when(F.col("entity") == "", F.col("raw_entity")).otherwise(F.col("entity")))
    return look_up(named, lookup, "entity", "raw_entity")


def fill_new_rows(layout: DataFrame, columns: DataFrame, entities: DataFrame, lookup: DataFrame) -> DataFrame:
    """Blank template: one row per entity (``entities(template, sheet, entity, pos)``) in order."""
    placed = rank_by_position(entities, "pos", SHEET, "_k").join(
        per_sheet(layout.select(*SHEET, F.col("row").alias("_h"))), list(SHEET)
    ).withColumn("row", F.col("_h") + F.col("_k"))
    return look_up(placed.drop("_h", "_k", "pos").join(per_sheet(columns), list(SHEET)), lookup, "entity")


def assign_rows(rows: DataFrame, layout: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity of every template row: existing ones, blanks in order, leftovers appended.

    Blank rows and entities are two sequences per sheet, numbered in one pass and zipped by their number, so a sheet with
    most rows is spread over all tasks; an entity that already has a row still uses up its turn, as the rule demands.
    """
    given = rows.where("entity <> ''").select(*SHEET, "row", "entity", F.lit(False).alias("is_new"))
    both = rows.where("entity = ''").select(*SHEET, F.lit(True).alias("_blank"), F.col("row").cast("long").alias("_at"), "row", F.lit(None).cast("string").alias("entity"))
    both = both.unionByName(entities.select(*SHEET, F.lit(False).alias("_blank"), F.col("pos").cast("long").alias("_at"), F.lit(None).cast("int").alias("row"), "entity"))
    ranked = rank_by_position(both, "_at", [*SHEET, "_blank"], "_k")
    zipped = materialised(ranked.groupBy(*SHEET, "_k").agg(F.max("row").alias("row"), F.max("entity").alias("entity")), "zipped")
    drawn = zipped.where("row is not null and entity is not null").select(*SHEET, "row", "entity", F.lit(True).alias("is_new"))
    last = rows.groupBy(*SHEET).agg(F.max("row").alias("_last"))
    start = layout.select(*SHEET, F.col("row").alias("_h")).join(last, list(SHEET), "left").select(*SHEET, F.coalesce("_last", "_h").alias("_from"))
    waiting = zipped.where("row is null").select(*SHEET, "entity", "_k")
    left = waiting.join(given.select(*SHEET, "entity").distinct(), [*SHEET, "entity"], "left_anti")
    appended = rank_by_position(left, "_k", SHEET, "_n").join(per_sheet(start), list(SHEET)).select(
        *SHEET, (F.col("_from") + F.col("_n")).alias("row"), "entity", F.lit(True).alias("is_new")
    )
    return given.unionByName(drawn).unionByName(appended)


def fill_mixed(rows: DataFrame, layout: DataFrame, columns: DataFrame, entities: DataFrame,
               lookup: DataFrame) -> DataFrame:
    """Existing entity rows in place, blank rows with the next entities, leftovers appended."""
    return look_up(assign_rows(rows, layout, entities).join(per_sheet(columns), list(SHEET)), lookup, "entity")


def place_in_order(items: DataFrame, rows: DataFrame, layout: DataFrame, pos: str = "pos") -> DataFrame:
    """The n-th item of a sheet on its n-th data row; further items below the last row."""
    slots = rank_by_position(rows, "row", SHEET, "_k").select(*SHEET, "_k", "row")
    size = rows.groupBy(*SHEET).agg(F.count("*").alias("_n"), F.max("row").alias("_last"))
    start = layout.select(*SHEET, F.col("row").alias("_h")).join(size, list(SHEET), "left")
    numbered = rank_by_position(items, pos, SHEET, "_k").join(per_sheet(start), list(SHEET))
    below = F.coalesce("_last", "_h") + F.col("_k") - F.coalesce("_n", F.lit(0))
    return numbered.join(slots, [*SHEET, "_k"], "left").withColumn(
        "row", F.coalesce("row", below).cast("int")
    ).drop("_k", "_h", "_n", "_last")


def fill_row_groups(groups: DataFrame, rows: DataFrame, layout: DataFrame, columns: DataFrame,
                    entities: DataFrame | None = None) -> DataFrame:
    """Blank template: one row per source row with enough template fields and an entity in scope.

    ``groups(template, sheet, entity_name, field_values map, pos)``.
    """
    need = columns.select(*SHEET, "field").distinct().groupBy(*SHEET).agg(
        F.collect_set("field").alias("_fields"))
    ok = groups.join(per_sheet(need), list(SHEET)).where(
        F.size(F.array_intersect(F.map_keys("field_values"), "_fields")) >= F.least(F.lit(2), F.size("_fields"))
    )
    if entities is not None:
        scope = entities.select(*SHEET, F.col("entity").alias("_scope")).distinct()
        ok = ok.withColumn("_scope", text.normalize_entity("entity_name")).join(scope, [*SHEET, "_scope"], "left_semi")
    placed = place_in_order(ok.drop("_fields"), rows, layout)
    values = placed.join(per_sheet(columns), list(SHEET)).withColumn("value", F.col("field_values")[F.col("field")])
    return values.where("value is not null").select(
        *SHEET, "row", "col", "field", F.col("entity_name").alias("entity"),
        numbers.to_double(F.col("value")).alias("value_num"), F.col("value").alias("value_text"),
    )


def fill_direct(rows_in: DataFrame, data: DataFrame, layout: DataFrame, columns: DataFrame,
                mapping: dict[str, str], entity_col: str, pos: str = "pos") -> DataFrame:
    """Structured source rows straight into template rows.

    ``rows_in(template, sheet, pos, <source columns>)``; ``mapping`` is template field →
    source column. Numeric text becomes a number; confidence 1.0.
    """
    placed = place_in_order(rows_in, data, layout, pos)
    pairs = F.array(*[
        text.record(field=F.lit(f), source=F.lit(c), raw=strip(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        for f, c in mapping.items()
    ])
    wide = placed.select(*SHEET, "row", F.col(entity_col).cast("string").alias("entity"), F.inline(pairs))
    filled = wide.where("raw <> '' and raw <> 'None'").join(per_sheet(columns), [*SHEET, "field"])
    num = F.col("raw").try_cast("double")
    return filled.select(
        *SHEET, "row", "col", "field", "entity", num.alias("value_num"),
        F.when(num.isNull(), F.col("raw")).alias("value_text"), F.lit("direct_search").alias("fact_id"),
        F.lit(1.0).alias("confidence"), F.concat_ws("=", "source", "raw").alias("source_span"),
    )


def fill_warnings(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """(cell_ref, warning) for implausible filled values."""
    f = facts.select("fact_id", F.col("value_num").alias("_v"), F.col("field_name").alias("_f"),
                     F.col("year").alias("_y"), F.col("confidence").alias("_c"))
    signed = F.col("_f").isin(*fv.SIGNED_FIELDS)
    checks = F.array_compact(F.array(
        F.when((F.col("_v") < 0) & ~signed, F.lit("negative")),
        F.when(F.abs("_v") > 1e12, F.lit("huge")),
        F.when((F.col("_y") < 1950) | (F.col("_y") > 2030), F.lit("year")),
        F.when(F.col("_c") < 0.6, F.lit("low_confidence")),
    ))
    return cells.join(f, "fact_id").select(
        *[c for c in ("task_id", "sheet_name", "cell_ref", "fact_id") if c in cells.columns],
        F.explode(checks).alias("warning"),
    )


def unfilled_fields(required: DataFrame, cells: DataFrame) -> DataFrame:
    """Required fields no filled cell carries."""
    have = cells.select(F.col("field_name").alias("field")).distinct()
    return required.join(have, "field", "left_anti").select("field")


def intent_columns(headers: DataFrame, intent_fields, vocab: Vocabulary) -> DataFrame:
    """Template columns of intent fields: exact name, else canonical name, else cleaned name.

    ``headers(template, sheet, col, value)``; entity columns are never field columns.
    """
    spark = headers.sparkSession
    wanted = parameter_table(spark, [(f.lower(), f) for f in intent_fields], "_low string, intent_field string")
    cells = headers.where(~text.is_entity_header("value", vocab.entity_headers)).withColumn(
        "_s", text.normalize_header("value")).where("_s <> ''")
    named = canonicalize_headers(cells, "value", vocab)
    keys = F.array(F.lower("_s"), F.lower("field"))
    tried = named.select(*SHEET, "col", F.posexplode(keys).alias("_tier", "_low")).join(wanted, "_low")
    return top_per_group(tried, [*SHEET, "col"], [F.asc("_tier")]).select(
        *SHEET, "col", F.col("intent_field").alias("field"))
