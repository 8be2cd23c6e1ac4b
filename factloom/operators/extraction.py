"""Blocks to facts: table rows, running text, pluggable extractors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates, numbers, text
from factloom.functions import fixed_values as fv
from factloom.functions.text import record, strings, strip
from factloom.operators import gazetteer
from factloom.operators.common import numbered, top_per_group
from factloom.session import materialised, parameter_table
from factloom.sources.blocks import row_entries
from factloom.sources.vocabulary import Vocabulary

# Confidence values of the extraction rules (fixed values).
TABLE_WITH_ENTITY, TABLE_WITHOUT_ENTITY = 0.95, 0.86
TEXT_WITH_ENTITY, TEXT_WITHOUT_ENTITY = 0.88, 0.72
CONFIRM_FROM = 0.8
HOOK_CONFIDENCE = {
    "fallback": (0.75, "pending_review"),
    "targeted": (0.90, "confirmed"),
    "intent": (0.92, "confirmed"),
}


def normalize_name(name: str, suffixes) -> str:
    """Driver-side twin of ``functions.text.normalize_entity`` for dictionary entries."""
    name = re.sub(r"[\s:：\-_/]+", "", name)
    for suffix in suffixes:
        if name.endswith(suffix) and len(name) > 2:
            name = name[: -len(suffix)]
    return name


INLINE_NAMES = 64  # names up to which the rows of tables are searched by column expressions


def mentions(c: Column, vocab: Vocabulary, extra: Column | None = None) -> Column:
    """Dictionary names occurring in a text, in dictionary order, then extra candidates.

    A name counts plain or with a suffix (which contains it), so one search for the names is enough; results are
    normalised and distinct. All names are found in one pass over the text (see ``gazetteer``).
    """
    if vocab.names:
        normal = gazetteer.normalised_names_in(c, vocab.names, tuple(normalize_name(n, vocab.name_suffixes) for n in vocab.names))
    else:
        normal = F.array().cast("array<string>")
    if extra is not None:
        more = F.transform(
            F.coalesce(extra, F.array().cast("array<string>")),
            lambda e: text.normalize_entity(e, vocab.name_suffixes),
        )
        normal = F.concat(normal, F.filter(more, lambda e: F.contains(c, e)))
    return F.array_distinct(F.filter(normal, lambda n: n != ""))


def first_mention(texts: Column, vocab: Vocabulary) -> Column:
    """The first dictionary name, normalised, of the first text of an array that contains one."""
    if len(vocab.names) > INLINE_NAMES:
        return gazetteer.first_name_in(texts, vocab.names, tuple(normalize_name(n, vocab.name_suffixes) for n in vocab.names))
    names = F.array(*[record(n=F.lit(n), e=F.lit(normalize_name(n, vocab.name_suffixes))) for n in vocab.names if n])
    if not vocab.names:
        return F.lit(None).cast("string")
    inside = F.transform(texts, lambda t: F.get(F.filter(names, lambda p: (p["e"] != "") & F.contains(t, p["n"])), F.lit(0))["e"])
    return F.get(F.filter(inside, lambda e: e.isNotNull()), F.lit(0))


def find_mentions(texts: DataFrame, id_col: str, text_col: str, vocab: Vocabulary) -> DataFrame:
    """(id, ord, entity) for every dictionary entity of every text."""
    return texts.select(
        id_col, F.posexplode(mentions(F.coalesce(F.col(text_col), F.lit("")), vocab)).alias("i", "entity")
    ).select(id_col, (F.col("i") + 1).alias("ord"), "entity")


def find_mentions_join(texts: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """(id, ord, entity) for a gazetteer that is a table ``names(name, ord)``, of any length."""
    return gazetteer.mentioned(texts, id_col, text_col, names).withColumnRenamed("name", "entity")


def fact_id(*parts) -> Column:
    """Readable content key: unique because block ids are."""
    return F.concat_ws("|", *parts)


def canonicalize(df: DataFrame, vocab: Vocabulary, field: str, value: str, unit: str,
                 convert: Column | None = None) -> DataFrame:
    """Values and units in the canonical unit of their field; adds ``field_entity_type``.

    The two vocabulary joins are equi joins against tables bounded by the vocabulary size.
    """
    spark = df.sparkSession
    fields = vocab.field_table(spark).withColumnRenamed("field", "_vf").withColumn("_known", F.lit(True))
    factors = vocab.factor_table(spark).select(
        F.col("field").alias("_ff"), "from_unit", "to_unit", "mul", "div"
    )
    joined = df.join(fields, F.col(field) == F.col("_vf"), "left").join(
        factors, (F.col(field) == F.col("_ff")) & (F.col(unit) == F.col("from_unit")), "left"
    )
    has_unit = F.coalesce("_known", F.lit(False)) & F.col("canonical_unit").isNotNull()
    result = numbers.canonical_value(
        F.col(value), F.col(unit), has_unit, F.col("canonical_unit"), F.col("to_unit"),
        F.col("mul"), F.col("div"),
    )
    if convert is not None:
        result = F.when(convert, result).otherwise(
            record(value=F.col(value), unit=F.col(unit))
        )
    return (
        joined.withColumn("_cv", result)
        .withColumn(value, F.col("_cv.value"))
        .withColumn(unit, F.col("_cv.unit"))
        .drop("_cv", "_vf", "_ff", "from_unit", "to_unit", "mul", "div")
    )


def canonicalize_headers(df: DataFrame, header: str, vocab: Vocabulary, out: str = "field") -> DataFrame:
    """Canonical field of a raw header, else its cleaned name, else NULL."""
    lookup = vocab.header_table(df.sparkSession).withColumnRenamed("field", "_field")
    return (
        df.withColumn("_key", text.header_key(header))
        .join(lookup, F.col("_key") == F.col("alias_key"), "left")
        .withColumn("is_canonical_field", F.col("_field").isNotNull())
        .withColumn(out, F.coalesce("_field", text.passthrough_name(header)))
        .drop("_key", "alias_key", "_field")
    )


def extract_table_facts(blocks: DataFrame, vocab: Vocabulary, file_name: str = "file_name",
                        row_numbers_as_dates: bool = False) -> DataFrame:
    """One fact per row and value column.

    Entity, date and year are settled inside the row; cells are then exploded and joined
    with the (small) vocabulary. No shuffle.
    """
    rows = blocks.where((F.col("block_type") == "table_row") & F.col("cells").isNotNull())
    name = F.coalesce(F.col(file_name), F.lit(""))
    keyed = rows.withColumn("_entries", F.transform(
        F.filter(row_entries("headers", "cells"), lambda e: e["header"] != ""),
        lambda e: record(pos=e["pos"], header=e["header"], value=e["value"], key=text.header_key(e["header"])),
    ))
    known = list(vocab.header_lookup)
    dates_ = [*fv.DATE_HEADERS, *vocab.date_headers, *(fv.ROW_NUMBER_HEADERS if row_numbers_as_dates else ())]
    role = lambda e: (
        F.when(e["key"].isin(*fv.ENTITY_HEADERS, *vocab.entity_headers), "entity")
        .when(e["key"].isin(*dates_), "date")
        .when(e["key"].isin(*known) if known else F.lit(False), "field")
        .when(text.passthrough_name(e["header"]).isNotNull(), "other")
    )
    staged = keyed.withColumn("_entries", F.transform(
        F.filter("_entries", lambda e: e["value"] != ""),
        lambda e: record(pos=e["pos"], header=e["header"], value=e["value"], key=e["key"], role=role(e)),
    ))
    of_role = lambda r: F.filter("_entries", lambda e: e["role"] == r)
    first = lambda r: F.get(of_role(r), F.lit(0))["value"]
    by_column = text.none_if_empty(text.normalize_entity(first("entity"), vocab.name_suffixes))
    # Without a named column, the first name of an unknown column counts, else the first of the whole row.
    unnamed = F.when(by_column.isNull(), F.concat(F.transform(of_role("other"), lambda e: e["value"]), F.array(F.coalesce("text", F.lit("")))))
    staged = staged.select(
        "block_id", "doc_id", "text", "page_or_index", name.alias("_file"),
        F.coalesce(by_column, first_mention(unnamed, vocab)).alias("_entity"),
        dates.parse_date(first("date")).alias("_date"),
        F.coalesce(dates.infer_year("text"), dates.infer_year(name)).alias("year"),
        F.transform(
            F.filter("_entries", lambda e: e["role"].isin("field", "other")),
            lambda e: record(
                pos=e["pos"], header=e["header"], value=e["value"], key=e["key"],
                n=numbers.number_unit(e["value"], vocab.cell_units),
            ),
        ).alias("_values"),
    )
    cells = staged.select("*", F.inline_outer("_values")).where(F.col("pos").isNotNull()).drop("_values")
    lookup = vocab.header_table(blocks.sparkSession).withColumnRenamed("field", "_field")
    fields = cells.join(lookup, F.col("key") == F.col("alias_key"), "left").withColumn(
        "field_name", F.coalesce("_field", text.passthrough_name("header")))
    valued = fields.select(
        "*", F.col("n.value").alias("value_num"),
        F.coalesce(F.col("n.unit"), text.header_unit("header")).alias("unit"),
    )
    # A passthrough header may itself be a catalog field name; conversion follows the field.
    conv = canonicalize(valued, vocab, "field_name", "value_num", "unit", F.col("_known").isNotNull())
    entity_type = F.coalesce("field_entity_type", F.lit("generic"))
    required = entity_type.isin(*vocab.entity_required) if vocab.entity_required else F.lit(False)
    has_entity = F.col("_entity").isNotNull()
    facts = conv.where(has_entity | ~required).select(
        fact_id("block_id", F.col("pos").cast("string")).alias("fact_id"),
        entity_type.alias("entity_type"),
        F.coalesce("_entity", "_file").alias("entity_name"),
        "field_name", "value_num", F.col("value").alias("value_text"),
        F.when(F.col("value_num").isNotNull(), F.col("unit")).alias("unit"),
        "year", F.col("doc_id").alias("source_doc_id"), F.col("block_id").alias("source_block_id"),
        F.col("text").alias("source_span"),
        F.when(has_entity, TABLE_WITH_ENTITY).otherwise(TABLE_WITHOUT_ENTITY).alias("confidence"),
        F.lit("confirmed").alias("status"),
        F.when(F.col("_date").isNotNull(), F.create_map(F.lit("date"), F.col("_date")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
        place_in_document(F.coalesce("page_or_index", F.lit(0)), F.col("pos")).alias("pos"),
    )
    return facts


def place_in_document(index: Column, column: Column) -> Column:
    """Place of a fact in its document: block index, then column (or number of the span) in the block."""
    return F.shiftleft(index.cast("long"), 20) + column.cast("long")


def running_positions(facts: DataFrame, order: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Facts with ``pos`` as a gap-free running number over all documents: the order in which facts first appear.

    ``order(doc_id, doc_pos)`` gives the order of the documents (default: by id; documents without a place come last).
    Inside a document facts follow block index and column. Numbered by ranges, so no document is one task.
    """
    n = partitions or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = facts.withColumnRenamed("pos", "_place")
    if order is None:
        rows = rows.withColumn("_doc", F.lit(0).cast("long"))
    else:
        named = order.select(F.col("doc_id").alias("_id"), F.col("doc_pos").cast("long").alias("_doc"))
        rows = rows.join(named, F.col("source_doc_id") == F.col("_id"), "left").drop("_id")
        rows = rows.withColumn("_doc", F.coalesce("_doc", F.lit(1 << 62)))
    return numbered(rows, [], ["_doc", "source_doc_id", "_place", "fact_id"], "pos", n).drop("_doc", "_place")


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """One fact per (entity, field, text value, block): highest confidence, first wins ties."""
    keys = ["entity_name", "field_name", "value_text", "source_block_id"]
    return top_per_group(facts, keys, [F.desc("confidence"), F.asc("pos"), F.asc("fact_id")])


# Fixed patterns: a party name after its label, and a date.
PARTY_TEXT = "(?:为|是|:|：)(?U:\\s*)([^，。；;\\n]{2,40})"
DAY_TEXT = "((?:19|20)\\d{2}[年/-]\\d{1,2}[月/-]\\d{1,2}日?)"

# --- running text ----------------------------------------------------------------------

# What an alias stands for (fixed values): a number, a party name after it, or a day after it.
NUMBER, PARTY, DAY = "number", "party", "day"
AROUND = 8  # characters on both sides in which a longer alias of another field hides a match
SPAN = "struct<start:int,end:int,ord:int,n:int,field:string,unit:string,kind:string,required:boolean>"


def alias_entries(vocab: Vocabulary) -> list[tuple[str, dict, tuple[str, ...]]]:
    """Of each alias, in lower case: what it stands for, and the longer aliases of other fields that contain it.

    Aliases are searched in each other by one automaton, so the table takes time in proportion to their text.
    """
    fields = {f.name: f for f in vocab.fields}
    rows = [(alias.lower(), name, ord_) for ord_, (alias, _, name, _) in enumerate(vocab.alias_rows)]
    inside = gazetteer.contained([alias for alias, *_ in rows])
    longer: dict[str, set[tuple[str, str]]] = {}
    for place, (other, name, _) in enumerate(rows):
        for at in inside[place]:
            if len(other) > len(rows[at][0]):
                longer.setdefault(rows[at][0], set()).add((other, name))

    def entry(alias: str, name: str, ord_: int) -> dict:
        field = fields[name]
        kind = PARTY if name in vocab.text_fields else DAY if name in vocab.date_fields else NUMBER
        return {"ord": ord_, "n": len(alias), "field": name, "unit": field.unit, "kind": kind, "required": (field.entity_type or "generic") in vocab.entity_required}

    return [(alias, entry(alias, name, ord_), tuple(sorted({o for o, other in longer.get(alias, ()) if other != name}))) for alias, name, ord_ in rows]


def alias_spans(body: Column, vocab: Vocabulary) -> Column:
    """Alias occurrences of a text, in any case, that no longer alias of another field around them hides: array of ``SPAN``, by start.

    One pass of an automaton over all aliases finds them (see ``gazetteer``).
    """
    return gazetteer.spans_in(body, alias_entries(vocab), AROUND, SPAN)


def without_overlaps(found: Column) -> Column:
    """Of overlapping spans the one that sorts first, in sorted order."""
    none = F.filter(found, lambda x: F.lit(False))
    return F.aggregate(F.array_sort(found), none, lambda acc, x: F.when(
        F.exists(acc, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(x))))


def _window(body: Column, start: Column, length) -> Column:
    return F.substring(body, start + 1, length if isinstance(length, Column) else F.lit(length))


def nearest_entity(positions: Column, anchor: Column) -> Column:
    """Entity whose first occurrence is the last at or before the anchor, else the first one."""
    before = F.filter(positions, lambda p: p["at"] <= anchor)
    return F.coalesce(
        F.get(F.reverse(before), F.lit(0))["name"], F.get(positions, F.lit(0))["name"]
    )


def entity_positions(body: Column, section_path: Column, vocab: Vocabulary) -> Column:
    """Sorted array of struct<at, ord, name> of the first occurrence of each entity (0-based)."""
    names = mentions(body, vocab, section_path)
    located = F.transform(
        names,
        lambda n, i: record(at=F.position(n, body) - 1, ord=i, name=n),
    )
    return F.array_sort(F.filter(located, lambda p: p["at"] >= 0))


def distinct_spans(settled: Column, file: Column) -> Column:
    """Of a block's spans the one of each (entity, field, text value) that ``dedupe_facts`` keeps: array<struct<i, s>> with their places.

    ``settled`` is sorted without equal elements, so of two spans the smaller one comes first.
    """
    name = lambda s: F.coalesce(s["entity"], file)
    sure = lambda s: s["entity"].isNotNull()

    def beaten(x: Column) -> Column:
        return F.exists(settled, lambda y: (y["value_text"] == x["value_text"]) & (y["field_name"] == x["field_name"]) & (name(y) == name(x)) & (
            (sure(y) & ~sure(x)) | ((sure(y) == sure(x)) & (y < x))))

    placed = F.transform(settled, lambda s, i: record(_i=i, _s=s))
    return F.when(F.size(settled) > 1, F.filter(placed, lambda p: ~beaten(p["_s"]))).otherwise(placed)


def extract_text_facts(blocks: DataFrame, vocab: Vocabulary, file_name: str = "file_name", distinct: bool = False) -> DataFrame:
    """Alias occurrences in prose with their nearest entity and number.

    ``distinct``: as ``dedupe_facts`` leaves them where no block comes twice; settled inside the block, without a shuffle.
    """
    prose = blocks.where((F.col("block_type") != "table_row") & (F.coalesce("text", F.lit("")) != ""))
    name = F.coalesce(F.col(file_name), F.lit(""))
    staged = prose.select(
        "block_id", "doc_id", "section_path", name.alias("_file"), F.coalesce("page_or_index", F.lit(0)).alias("_index"),
        text.collapse_cjk_spaces("text").alias("_body"),
    )
    body = F.col("_body")
    staged = staged.withColumn("_spans", alias_spans(body, vocab))
    staged = staged.withColumn("_positions", entity_positions(body, F.col("section_path"), vocab))

    # A span counts, and keeps others off its place, only where it gives a value; so values are read
    # inside the row, before overlaps are settled and the spans exploded.
    def valued(s: Column) -> Column:
        start, end = s["start"], s["end"]
        lead, left = F.least(start, F.lit(40)), F.greatest(start - 24, F.lit(0))
        number = s["kind"] == NUMBER
        fits = lambda n: n["value"].isNotNull() & numbers.unit_compatible(n["unit"], s["unit"])
        after = numbers_in(_window(body, end, 40), vocab.prose_units, False)
        # What stands in front is read only where the number behind does not do.
        before = text.let(numbers_in(_window(body, start - lead, lead), vocab.prose_units, True), lambda n: F.when(fits(n), n))
        near = F.when(number, text.let(after, lambda n: F.when(fits(n), n).otherwise(before)))

        def settled(w: Column) -> Column:
            return record(
                by_length=-s["n"], ord=s["ord"], start=start, end=end, field_name=s["field"], entity=w["entity"],
                value_num=w["near"]["value"], unit=w["near"]["unit"], text_value=~number, required=s["required"],
                value_text=F.when(s["kind"] == PARTY, strip(F.regexp_extract(_window(body, end, 48), PARTY_TEXT, 1)))
                .when(s["kind"] == DAY, F.regexp_extract(_window(body, end, 40), DAY_TEXT, 1))
                .otherwise(strip(_window(body, left, end + 24 - left))))

        return text.let(record(near=near, entity=nearest_entity(F.col("_positions"), start)), settled)

    holds = lambda v: (v["entity"].isNotNull() | ~v["required"]) & F.when(
        v["text_value"], v["value_text"] != "").otherwise(v["value_num"].isNotNull())
    staged = staged.withColumn("_found", F.filter(F.transform("_spans", valued), holds))
    if distinct:
        staged = staged.withColumn("_settled", without_overlaps(F.col("_found")))
        spans = F.inline_outer(distinct_spans(F.col("_settled"), F.col("_file")))
    else:
        spans = F.posexplode_outer(without_overlaps(F.col("_found"))).alias("_i", "_s")
    staged = staged.select(
        "block_id", "doc_id", "_file", "_body", "_index",
        F.coalesce(dates.infer_year(body), dates.infer_year("_file")).alias("year"), spans,
    ).where(F.col("_i").isNotNull()).select(
        "block_id", "doc_id", "_file", "_body", "_index", "year", "_i", "_s.field_name", F.col("_s.entity").alias("_entity"),
        "_s.value_num", "_s.unit", "_s.value_text", F.col("_s.text_value").alias("_text_value"))
    conv = canonicalize(staged, vocab, "field_name", "value_num", "unit", ~F.col("_text_value"))
    entity_type = F.coalesce("field_entity_type", F.lit("generic"))
    confidence = F.when(F.col("_entity").isNotNull(), TEXT_WITH_ENTITY).otherwise(TEXT_WITHOUT_ENTITY)
    return conv.select(
        fact_id("block_id", F.lit("t"), F.col("_i").cast("string")).alias("fact_id"),
        entity_type.alias("entity_type"), F.coalesce("_entity", "_file").alias("entity_name"),
        "field_name", "value_num", "value_text", "unit", "year",
        F.col("doc_id").alias("source_doc_id"), F.col("block_id").alias("source_block_id"),
        body.alias("source_span"), confidence.alias("confidence"),
        F.when(confidence >= CONFIRM_FROM, "confirmed").otherwise("pending_review").alias("status"),
        F.create_map().cast("map<string,string>").alias("metadata"), place_in_document(F.col("_index"), F.col("_i")).alias("pos"),
    )


def numbers_in(window: Column, units, backward: bool) -> Column:
    """First number of a window, or going backward the last one that is no bare year."""
    pattern = numbers.number_pattern(units)
    win = numbers.ascii_digits(window)
    if not backward:
        return text.let(F.regexp_extract(win, pattern, 0), lambda m: numbers.split_number(m, units))
    found = F.transform(
        F.regexp_extract_all(win, F.lit(f"({pattern})"), 1), lambda m: numbers.split_number(m, units)
    )

    def choose(turned: Column) -> Column:
        last = F.get(turned, F.lit(0))
        yearlike = last["unit"].isNull() & last["value"].between(1900, 2100) & (
            last["value"] == F.floor(last["value"])
        )
        return F.when(~yearlike, last).otherwise(F.get(turned, F.lit(1)))

    return text.let(F.reverse(found), choose)


def extract_facts(blocks: DataFrame, vocab: Vocabulary, file_name: str = "file_name") -> DataFrame:
    """Rows by the table rule, everything else by the text rule, deduplicated."""
    return dedupe_facts(
        extract_table_facts(blocks, vocab, file_name).unionByName(
            extract_text_facts(blocks, vocab, file_name)
        )
    )


# --- pluggable extractors --------------------------------------------------------------

HOOK_ROWS = "doc_id string, block_id string, entity_name string, field_name string, value string, unit string, evidence string"
Extractor = Callable[[pd.DataFrame], pd.DataFrame]


def run_extractor(chunks: DataFrame, extractor: Extractor, vocab: Vocabulary, method: str,
                  fields=None, file_name: str = "file_name") -> DataFrame:
    """Facts from a user-supplied extractor over chunk rows (doc_id, block_id, text, file_name).

    The extractor sees batches of chunks and returns rows of ``HOOK_ROWS``; the checks,
    number parsing, unit conversion and confidence are column work. ``fields`` (names, or a table ``(field)``)
    restricts the accepted field names. A fact's place is that of its chunk (``page_or_index``, if the chunks have it),
    then the number of its row among those of the chunk.
    """
    confidence, status = HOOK_CONFIDENCE[method]
    columns = [c.split(" ")[0] for c in HOOK_ROWS.split(", ")]
    shown = ["doc_id", "block_id", "text", file_name]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Year and span of a chunk travel with it, so its text is read once.
            own = batch[["block_id", "_year", "_span", "_index"]].drop_duplicates("block_id")
            rows = extractor(batch[shown]).reindex(columns=columns)
            yield rows.assign(_row=rows.groupby("block_id", dropna=False).cumcount()).merge(own, on="block_id", how="left")[
                [*columns, "_year", "_span", "_index", "_row"]].fillna({"_index": 0})

    index = F.coalesce("page_or_index", F.lit(0)) if "page_or_index" in chunks.columns else F.lit(0)
    year = F.coalesce(dates.infer_year("text"), dates.infer_year(file_name))
    sent = chunks.select(*shown, year.cast("double").alias("_year"), F.left("text", F.lit(200)).alias("_span"), index.cast("long").alias("_index"))
    raw = sent.mapInPandas(call, f"{HOOK_ROWS}, _year double, _span string, _index long, _row long")
    place = place_in_document(F.col("_index"), F.col("_row")).alias("pos")
    trimmed = raw.select("doc_id", "block_id", F.col("_year").cast("int").alias("year"), "_span", place, *[
        text.none_if_empty(strip(F.coalesce(c, F.lit("")))).alias(c)
        for c in ("entity_name", "field_name", "value", "unit", "evidence")
    ])
    ok = trimmed.where("entity_name is not null and field_name is not null and value is not null")
    wanted = None
    if fields is not None:
        given = fields if isinstance(fields, DataFrame) else parameter_table(chunks.sparkSession, [(f,) for f in fields], "field string")
        wanted = given.select(F.lower("field").alias("_wanted")).distinct()
        ok = ok.join(wanted, F.lower("field_name") == F.col("_wanted"), "left_semi")
    lookup = vocab.header_table(chunks.sparkSession).withColumnRenamed("field", "_canon")
    ok = ok.withColumn("_key", text.header_key("field_name")).join(
        lookup, F.col("_key") == F.col("alias_key"), "left"
    )
    resolved = F.coalesce("_canon", "field_name")
    if wanted is not None:
        ok = ok.join(wanted, F.lower("_canon") == F.col("_wanted"), "left")
        resolved = F.when(F.col("_wanted").isNotNull(), F.col("_canon")).otherwise(F.col("field_name"))
    num = numbers.number_unit("value", vocab.cell_units)
    ok = ok.withColumn("_n", num).select(
        "doc_id", "block_id", "year", "_span", "pos", "entity_name", "evidence", "value", "_canon", resolved.alias("field_name"),
        F.col("_n.value").alias("value_num"), F.coalesce("_n.unit", "unit").alias("unit"),
    )
    conv = canonicalize(ok, vocab, "_canon", "value_num", "unit", F.col("_canon").isNotNull())
    norm = text.normalize_entity("entity_name", vocab.name_suffixes)
    meta = F.create_map(
        F.lit("extraction_method"), F.lit(method),
        F.lit("evidence_text"), F.left(F.coalesce("evidence", F.lit("")), F.lit(200)),
    )
    return conv.select(
        fact_id("block_id", F.lit(method), "entity_name", "field_name", "value").alias("fact_id"),
        F.coalesce("field_entity_type", F.lit("generic")).alias("entity_type"),
        F.when(norm == "", F.col("entity_name")).otherwise(norm).alias("entity_name"),
        "field_name", "value_num", F.col("value").alias("value_text"),
        F.when(F.col("value_num").isNotNull(), F.col("unit")).alias("unit"), "year",
        F.col("doc_id").alias("source_doc_id"), F.col("block_id").alias("source_block_id"),
        F.col("_span").alias("source_span"), F.lit(confidence).alias("confidence"),
        F.lit(status).alias("status"), meta.alias("metadata"), "pos",
    )


def missing_fields(required: DataFrame, facts: DataFrame) -> DataFrame:
    """Required, non-computed fields that no fact has. ``required(field, is_computed)``."""
    have = facts.select(F.col("field_name").alias("field")).distinct()
    return required.where(~F.coalesce("is_computed", F.lit(False))).join(have, "field", "left_anti").select("field")


def extract_by_intent(blocks: DataFrame, vocab: Vocabulary, required: DataFrame,
                      extractor: Extractor | None = None, date_from: str | None = None,
                      date_to: str | None = None, entities=(), file_name: str = "file_name") -> DataFrame:
    """Rule facts, filtered by intent; the extractor runs only for the fields still missing.

    The rule facts are a stored table, since both the missing fields and the result need them
    and the text would otherwise be parsed twice. The missing fields stay a table: without any no chunk is sent to the extractor.
    """
    from factloom.operators.lineage import with_evidence
    from factloom.operators.selection import intent_filter

    rule = with_evidence(
        intent_filter(extract_facts(blocks, vocab, file_name), date_from, date_to, entities), "rule"
    )
    if extractor is None:
        return rule
    rule = materialised(rule, "rule-facts")
    gaps = materialised(missing_fields(required, rule), "missing-fields")
    chunks = blocks.where(F.coalesce("text", F.lit("")) != "").where(gaps.exists())
    hooked = run_extractor(chunks, extractor, vocab, "intent", gaps, file_name)
    # Only rule facts whose field the extractor may name, in any case, can meet one of its facts; the others are settled already.
    asked = gaps.select(F.lower("field").alias("_asked")).distinct()
    may_meet = F.lower("field_name") == F.col("_asked")
    return rule.join(asked, may_meet, "left_anti").unionByName(dedupe_facts(rule.join(asked, may_meet, "left_semi").unionByName(hooked)))


def extract_with_fallback(blocks: DataFrame, vocab: Vocabulary, extractor: Extractor,
                          file_name: str = "file_name") -> DataFrame:
    """Rule facts; documents without any rule fact go to the extractor as a whole."""
    rule = materialised(extract_facts(blocks, vocab, file_name), "rule-facts")
    covered = rule.select(F.col("source_doc_id").alias("doc_id")).distinct()
    rest = blocks.where("block_type <> 'table_row'").join(covered, "doc_id", "left_anti")
    return rule.unionByName(dedupe_facts(run_extractor(rest, extractor, vocab, "fallback", None, file_name)))
