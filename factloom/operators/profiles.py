"""Summaries of documents, tables and templates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates, text
from factloom.functions import fixed_values as fv
from factloom.functions.text import let, record, strip
from factloom.operators.common import top_per_group
from factloom.operators.extraction import canonicalize_headers, mentions
from factloom.session import materialised, small_side
from factloom.sources.vocabulary import Vocabulary


def document_terms(facts: DataFrame) -> DataFrame:
    """Distinct (doc_id, kind, term): the fields and entities of canonical facts.

    Long form, so a document with millions of entities is many rows, not one array.
    """
    pair = lambda kind, c: record(kind=F.lit(kind), term=F.col(c))
    return (
        facts.where("is_canonical")
        .select(
            F.col("source_doc_id").alias("doc_id"),
            F.inline(F.array(pair("field", "field_name"), pair("entity", "entity_name"))),
        )
        .where("term is not null and term <> ''")
        .distinct()
    )


def text_preview(blocks: DataFrame, n: int = 4, chars: int = 120) -> DataFrame:
    """First blocks of each document, shortened and joined by line breaks."""
    heads = top_per_group(
        blocks.select("doc_id", "page_or_index", "block_id", F.left("text", F.lit(chars)).alias("t")),
        ["doc_id"], [F.asc_nulls_last("page_or_index"), F.asc("block_id")], n, rank="_k",
    )
    parts = F.array_sort(F.collect_list(F.struct("_k", "t")))
    return heads.groupBy("doc_id").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text_preview")
    )


def document_stats(blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """Blocks, structured rows, text blocks and facts per document."""
    b = blocks.groupBy("doc_id").agg(
        F.count("*").alias("block_count"),
        F.count_if(F.col("cells").isNotNull()).alias("structured_count"),
        F.count_if(F.col("block_type").isin("paragraph", "heading")).alias("text_count"),
    )
    f = facts.groupBy(F.col("source_doc_id").alias("doc_id")).agg(F.count("*").alias("fact_count"))
    counts = ("block_count", "structured_count", "text_count", "fact_count")
    return b.join(f, "doc_id", "full").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    )


def document_cards(docs: DataFrame, blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """One card per document: counts, number of distinct fields and entities, preview.

    The term sets themselves are ``document_terms``.
    """
    terms = document_terms(facts).groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "field").alias("n_fields"),
        F.count_if(F.col("kind") == "entity").alias("n_entities"),
    )
    stats = document_stats(blocks, facts.where("is_canonical")).select("doc_id", "fact_count", "block_count")
    counts = ("fact_count", "block_count", "n_fields", "n_entities")
    return (
        docs.join(stats, "doc_id", "left").join(terms, "doc_id", "left")
        .join(text_preview(blocks), "doc_id", "left")
        .select(
            *docs.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            F.coalesce("text_preview", F.lit("")).alias("text_preview"),
        )
    )


def keyword_table(df: DataFrame, key: str, text_col: str, stop_words=fv.GENERIC_TOKENS) -> DataFrame:
    """Keywords of long texts: (key, first_pos, keyword), case-insensitively distinct.

    A text is made distinct inside its row by sorting its tokens, so only keys are shuffled; rows whose key comes more than once
    (none in a table of documents) are then combined by key.
    """
    def firsts(tokens: Column) -> Column:
        ordered = F.array_sort(F.transform(tokens, lambda t, i: record(low=F.lower(t), p=i, token=t)))
        return let(ordered, lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["low"] != x["low"])))

    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_again"))
    # Stored and counted, so that the texts are not shuffled to meet a table of few or no keys.
    again = small_side(materialised(again, "repeated-keys"), 64)
    same = F.col(key).eqNullSafe(F.col("_again"))
    found = lambda rows: rows.select(key, F.inline(firsts(text.keyword_tokens(text_col, stop_words))))
    merged = found(df.join(again, same, "left_semi")).groupBy(key, "low").agg(F.min(F.struct("p", "token")).alias("m"))
    return (
        found(df.join(again, same, "left_anti")).select(key, F.col("p").alias("first_pos"), F.col("token").alias("keyword"))
        .unionByName(merged.select(key, F.col("m.p").alias("first_pos"), F.col("m.token").alias("keyword")))
    )


def distinct_in_order(df: DataFrame, value: Column, pos: Column) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.select(value.alias("value"), pos.alias("pos")).where(
        F.col("value").isNotNull() & (F.col("value") != "")
    ).groupBy("value").agg(F.min("pos").alias("first_pos"))


def distinct_headers(blocks: DataFrame, pos: Column) -> DataFrame:
    """Distinct headers over all structured rows in first-seen order.

    ``first_pos`` is struct<block position, column>; equal header lists are combined first.
    """
    per_list = blocks.where(F.col("headers").isNotNull()).groupBy("headers").agg(F.min(pos).alias("p"))
    cells = per_list.select("p", F.posexplode("headers").alias("c", "header"))
    return cells.groupBy("header").agg(F.min(F.struct("p", "c")).alias("first_pos"))


def distinct_values(rows: DataFrame, column: str, pos: Column, chars: str = "市县区") -> DataFrame:
    """Distinct column values without administrative suffixes, in first-seen order."""
    clean = F.regexp_replace(strip(F.coalesce(F.col(column).cast("string"), F.lit(""))), f"[{chars}]+$", "")
    return distinct_in_order(rows, clean, pos)


RSD = 0.02  # relative standard deviation of the distinct counts of a sketch


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[record(column=F.lit(c), value=F.col(f"`{c}`").cast("string")) for c in columns])))


def table_profile(df: DataFrame, max_distinct: int = 30, max_values: int = 15, sketch: bool = False) -> DataFrame:
    """Per column: type, rows, non-null count, distinct count, values of categorical columns, whether the distinct count is exact.

    One pass makes mergeable sketches of all columns. Only columns that the sketch calls small are then counted value by value (exact,
    pre-aggregated on the map side), and those with 2 to ``max_distinct`` values list up to ``max_values`` of them. With ``sketch`` the
    distinct counts of the other columns stay estimates (relative standard deviation ``RSD``) and none of their values is shuffled;
    without it they are counted exactly.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    told = df.agg(*(record(rows=F.count(F.lit(1)), non_null=F.count(f"`{c}`"), about=F.approx_count_distinct(f"`{c}`", RSD)).alias(f"c{i}")
                    for i, c in enumerate(df.columns))).first()
    of = {c: told[f"c{i}"] for i, c in enumerate(df.columns)}
    # The sketch is off by more than five deviations for no column in practice; twice the bound leaves room for far more.
    small = [c for c in df.columns if of[c]["about"] <= 2 * max_distinct + 2]
    large = [c for c in df.columns if c not in small]
    stats = df.sparkSession.createDataFrame(
        [(c, types[c], of[c]["rows"], of[c]["non_null"], of[c]["about"]) for c in df.columns], "column string, type string, rows long, non_null long, about long")
    counted = []
    if small:
        values = _long(df, small).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        few = F.array_join(F.slice(F.sort_array(F.collect_list("value")), 1, max_values), ", ")  # a small column has few values
        counted.append(values.groupBy("column").agg(F.count(F.lit(1)).alias("n"), few.alias("sample")))
    if large and not sketch:
        values = _long(df, large).where("value is not null").distinct()
        counted.append(values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).withColumn("sample", F.lit(None).cast("string")))
    exact = F.col("column").isin(*(small if sketch else df.columns)) if small or not sketch else F.lit(False)
    if not counted:
        return stats.select("column", "type", "rows", "non_null", F.col("about").alias("n_distinct"), F.lit(None).cast("string").alias("values"), exact.alias("exact"))
    found = functools.reduce(DataFrame.unionByName, counted)
    joined = stats.join(found, "column", "left")
    n = F.when(exact, F.coalesce("n", F.lit(0).cast("long"))).otherwise(F.col("about"))
    return joined.select("column", "type", "rows", "non_null", n.alias("n_distinct"),
                         F.when(exact & n.between(2, max_distinct), F.col("sample")).alias("values"), exact.alias("exact"))


def head_sample(df: DataFrame, order, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def template_fields(cells: DataFrame, vocab: Vocabulary, max_row: int = 10) -> DataFrame:
    """Distinct (template, field) named in the first rows of a template."""
    named = canonicalize_headers(cells.where(F.col("row") <= max_row), "value", vocab)
    return named.where("field is not null").select("template", "field").distinct()


def template_entities(cells: DataFrame, layout: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Distinct (template, entity): the entity column below the header, and names mentioned."""
    column = cells.join(
        layout.select("template", "sheet", F.col("row").alias("_h"), "entity_col"), ["template", "sheet"]
    ).where((F.col("row") > F.col("_h")) & (F.col("col") == F.col("entity_col")))
    listed = column.select("template", text.normalize_entity(strip("value"), vocab.name_suffixes).alias("entity"))
    shown = cells.where((F.col("row") <= 20) & (F.col("col") <= 12))
    named = shown.select("template", F.explode(mentions(F.coalesce("value", F.lit("")), vocab)).alias("entity"))
    return listed.unionByName(named).where("entity <> ''").distinct()


def template_keywords(cells: DataFrame, n: int = 20) -> DataFrame:
    """First keywords of a template: its name, then the visible cells in reading order."""
    stem = F.regexp_replace("template", "(?<=.)\\.[^./]*$", "")
    names = cells.select("template", F.lit(0).alias("row"), F.lit(0).alias("col"), stem.alias("value")).distinct()
    shown = cells.where((F.col("row") <= 20) & (F.col("col") <= 12)).select("template", "row", "col", "value")
    tokens = names.unionByName(shown).select(
        "template", "row", "col", F.posexplode(text.keyword_tokens("value")).alias("p", "token")
    )
    firsts = tokens.groupBy("template", F.lower("token").alias("_low")).agg(
        F.min(F.struct("row", "col", "p", "token")).alias("m")
    )
    return top_per_group(
        firsts.select("template", "m.*"), ["template"], [F.asc("row"), F.asc("col"), F.asc("p")], n, rank="ord"
    ).select("template", "ord", F.col("token").alias("keyword"))


def sample_texts(cells: DataFrame, n: int = 12) -> DataFrame:
    """First visible texts of a template: its name, then non-blank cells in reading order."""
    stem = F.regexp_replace("template", "(?<=.)\\.[^./]*$", "")
    names = cells.select("template", F.lit(0).alias("row"), F.lit(0).alias("col"), stem.alias("value")).distinct()
    shown = cells.where((F.col("row") <= 20) & (F.col("col") <= 12)).select("template", "row", "col", "value")
    both = names.unionByName(shown).withColumn("value", strip("value")).where("value <> ''")
    return top_per_group(both, ["template"], [F.asc("row"), F.asc("col")], n, rank="ord")


def template_profile(cells: DataFrame, layout: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Fields, entities, keywords and sample texts of templates as (template, kind, term)."""
    parts = [
        template_fields(cells, vocab).select("template", F.lit("field").alias("kind"), F.col("field").alias("term")),
        template_entities(cells, layout, vocab).select(
            "template", F.lit("entity").alias("kind"), F.col("entity").alias("term")),
        template_keywords(cells).select("template", F.lit("keyword").alias("kind"), F.col("keyword").alias("term")),
        sample_texts(cells).select("template", F.lit("sample").alias("kind"), F.col("value").alias("term")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def template_intent(cells: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Required fields by rule: each distinct header of the first rows, in first-seen order."""
    header_rows = cells.groupBy("template", "sheet").agg(F.min("row").alias("row"))
    heads = cells.join(header_rows, ["template", "sheet", "row"]).withColumn("header", strip("value"))
    firsts = heads.where("header <> ''").groupBy("template", "header").agg(
        F.min(F.struct("sheet", "col")).alias("first_pos")
    )
    return (
        canonicalize_headers(firsts, "header", vocab)
        .where("field is not null")
        .select("template", "field", "header", F.col("first_pos.sheet").alias("sheet"),
                F.col("first_pos.col").alias("col"))
    )


def requirement_constraints(requirements: DataFrame, text_col: str = "requirement", **labels) -> DataFrame:
    """Date range and entity list read from a requirement text."""
    c = dates.date_constraint(text_col)
    return requirements.select(
        "*", c["lo"].alias("date_from"), c["hi"].alias("date_to"),
        dates.entity_list(text_col, **labels).alias("entities"),
    )
