"""Choosing source documents for templates: rules, file names, name similarity, vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed_values as fv
from factloom.functions import text
from factloom.operators import gazetteer
from factloom.operators.common import top_per_group
from factloom.session import parameter_table, small_table

# Thresholds of the matching rules (fixed values).
FIELD_WEIGHT, ENTITY_WEIGHT, KEYWORD_WEIGHT, KEYWORD_CAP = 3.0, 4.0, 0.5, 2.0
BLOCK_MIN, DOC_MIN, BLOCKS_PER_DOC, DOCS_PER_QUERY = 0.35, 0.45, 5, 5
OVERLAP_MIN, SHEET_SHARE_MIN = 0.3, 0.5


@dataclass(frozen=True)
class TemplateProfile:
    name: str
    fields: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()


def profile_terms(spark, profiles: Sequence[TemplateProfile]) -> DataFrame:
    """``(template, kind, term)`` of any number of templates, each term once."""
    rows = [(p.name, kind, t) for p in profiles for kind, ts in (("field", p.fields), ("entity", p.entities), ("keyword", p.keywords)) for t in dict.fromkeys(ts)]
    return parameter_table(spark, rows, "template string, kind string, term string")


def keyword_hits(cards: DataFrame, body: Column, wanted: DataFrame) -> DataFrame:
    """``(template, doc_id, term)`` for ``wanted(template, term)``: keywords, in any case, that a card's text contains.

    All keywords are searched at once (see ``gazetteer``), then joined to the templates that ask for them.
    """
    asked = wanted.select("template", "term", F.lower("term").alias("name")).where("name <> ''")
    words = asked.select("name").distinct().withColumn("ord", F.lit(0).cast("long"))
    found = gazetteer.mentioned(cards.select("doc_id", F.lower(body).alias("_body")), "doc_id", "_body", words)
    return found.join(asked, "name").select("template", "doc_id", "term")


def score_documents(cards: DataFrame, terms: DataFrame, profiles: Sequence[TemplateProfile]) -> DataFrame:
    """Rule score of every (template, document) that has a hit; pairs without one are never made.

    ``cards(doc_id, file_name, text_preview)``, ``terms(doc_id, kind, term)``. Field and entity hits are one equi join
    against the templates' terms, keyword hits come from one search for all keywords in each card. Hit lists are
    bounded by the template's own terms.
    """
    wanted = profile_terms(cards.sparkSession, profiles)
    plain = lambda df: df.withColumn(
        "term", F.when(F.col("kind") == "entity", text.normalize_entity("term")).otherwise(F.col("term")))
    named = plain(terms).join(plain(wanted.where("kind <> 'keyword'")).distinct(), ["kind", "term"]).select("template", "doc_id", "kind", "term")
    worded = keyword_hits(cards, F.concat_ws("\n", "file_name", "text_preview"), wanted.where("kind = 'keyword'")).select(
        "template", "doc_id", F.lit("keyword").alias("kind"), "term")
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("term")))).alias(f"{kind}_hits")
    hits = named.unionByName(worded).groupBy("template", "doc_id").agg(of("field"), of("entity"), of("keyword"))
    scored = hits.join(cards.select("doc_id", "file_name"), "doc_id").select(
        "template", "doc_id", "file_name", "field_hits", "entity_hits", "keyword_hits")
    score = (
        FIELD_WEIGHT * F.size("field_hits") + ENTITY_WEIGHT * F.size("entity_hits")
        + F.least(F.lit(KEYWORD_CAP), KEYWORD_WEIGHT * F.size("keyword_hits"))
    )
    return scored.withColumn("score", F.round(score, 4))


FALLBACK = "fallback_all"


def match_by_rules(scored: DataFrame, profiles: Sequence[TemplateProfile]) -> DataFrame:
    """Tiered choice: any entity hit, else field hit, else score ≥ max(half the top, 1), else all.

    The tier is one small aggregate per template, joined back; no window over all documents. A template that takes all
    documents is one row without a document, mode ``fallback_all``.
    """
    best = scored.groupBy("template").agg(
        F.bool_or(F.size("entity_hits") > 0).alias("_e"), F.bool_or(F.size("field_hits") > 0).alias("_f"),
        F.max("score").alias("_top"),
    )
    asked = parameter_table(scored.sparkSession, [(p.name, bool(p.fields)) for p in profiles], "template string, _has_fields boolean")
    best = best.join(asked, "template", "left")
    f_ok = F.col("_f") & F.coalesce("_has_fields", F.lit(False))
    cutoff = F.greatest(F.col("_top") * 0.5, F.lit(1.0))
    mode = F.when(F.col("_e"), "entity").when(f_ok, "field").when(F.col("_top") >= cutoff, "score").otherwise(FALLBACK)
    keep = (
        F.when(F.col("mode") == "entity", F.size("entity_hits") > 0)
        .when(F.col("mode") == "field", F.size("field_hits") > 0)
        .when(F.col("mode") == "score", F.col("score") >= cutoff).otherwise(False)
    )
    tiers = best.select("template", "_top", mode.alias("mode"))
    found = scored.join(tiers, "template").where(keep).drop("_top")
    settled = tiers.where(F.col("mode") != FALLBACK).select("template")
    whole = asked.select("template").join(settled, "template", "left_anti").withColumn("mode", F.lit(FALLBACK))
    return found.unionByName(whole, allowMissingColumns=True)


def suggest(scored: DataFrame, matched: DataFrame) -> DataFrame:
    """Candidates with a hit and their score relative to the best one; recommended unless all were taken."""
    top = scored.groupBy("template").agg(F.max("score").alias("_top"))
    modes = matched.groupBy("template").agg(F.max("mode").alias("mode"))
    real = (F.size("field_hits") > 0) | (F.size("entity_hits") > 0)
    return scored.join(top, "template").join(modes, "template", "left").select(
        "template", "doc_id", "file_name",
        F.round(F.col("score") / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top")), 4).alias("score"),
        "field_hits", F.slice("entity_hits", 1, 10).alias("entity_hits"),
        F.slice("keyword_hits", 1, 5).alias("keyword_hits"),
        (real & (F.col("mode") != FALLBACK)).alias("recommended"),
    )


def match_by_name(docs: DataFrame, templates: Sequence[str]) -> DataFrame:
    """(template, doc_id) where the file name contains a meaningful part of the template name."""
    asked = parameter_table(docs.sparkSession, [(t,) for t in templates], "template string")
    parts = asked.select("template", F.explode(text.filename_keywords("template")).alias("term"))
    hits = keyword_hits(docs, F.col("file_name"), parts).select("template", "doc_id").distinct()
    return hits.join(docs.select("doc_id", "file_name"), "doc_id").select("template", "doc_id", "file_name")


# --- vectors ---------------------------------------------------------------------------


QUERY_BLOCK = 4_096  # query vectors that one pass over the blocks compares


def _query_blocks(queries: DataFrame, query_id: str, vector: str) -> list[tuple[list, np.ndarray]]:
    """Ids and unit vectors of the queries in blocks of about ``QUERY_BLOCK``, each a parameter of one pass; zero and null vectors are left out."""
    n = 1 + queries.count() // QUERY_BLOCK
    out = []
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == i)
        rows = [r for r in part.where(F.col(vector).isNotNull()).select(query_id, vector).collect()]
        matrix = np.array([r[1] for r in rows], dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1) if rows else np.zeros(0)
        ok = norms > 0
        out.append(([r[0] for r, good in zip(rows, ok) if good], matrix[ok] / norms[ok, None] if rows else matrix))
    return out


def vector_scores(blocks: DataFrame, queries: DataFrame, block_id: str, vector: str, group: str | None,
                  k: int, min_score: float | None, query_id: str = "query_id",
                  query_vector: str = "vector") -> DataFrame:
    """Best ``k`` cosines per query (and group) of every Arrow batch.

    Queries are a table of any length: each ``QUERY_BLOCK`` of them is one pass, in which a task multiplies its batches with their
    matrix and sends on at most k rows per query and group. Zero vectors never match.
    """
    passes = [_scored_block(blocks, ids, matrix, dict(queries.dtypes)[query_id], block_id, vector, group, k, min_score)
              for ids, matrix in _query_blocks(queries, query_id, query_vector)]
    found = functools.reduce(DataFrame.unionByName, passes)
    return top_per_group(found, ["query_id"] + ([group] if group else []), [F.desc("score"), F.asc(block_id)], k, rank="rank")


def _scored_block(blocks: DataFrame, ids: list, matrix: np.ndarray, id_type: str, block_id: str, vector: str, group: str | None, k: int,
                  min_score: float | None) -> DataFrame:
    cols = [block_id] + ([group] if group else [])
    types = dict(blocks.dtypes)
    schema = f"query_id {id_type}, " + ", ".join(
        f"{c} {types[c]}" for c in cols) + ", score double"

    def best_of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", block_id], ascending=[False, True])
        return part.groupby(group, sort=False).head(k) if group else part.head(k)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch[vector].notna()]
            if not len(batch) or not ids:
                continue
            m = np.stack(batch[vector].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(m, axis=1)
            live = norms > 0
            cos = (m[live] / norms[live, None]) @ matrix.T
            left = batch.loc[live, cols].reset_index(drop=True)
            floor = np.full(len(ids), -np.inf if min_score is None else min_score)
            if not group and len(left) > k:
                # Rows below the k-th score of this batch cannot be among its best; ties stay.
                floor = np.maximum(floor, np.partition(cos, len(left) - k, axis=0)[len(left) - k])
            parts = []
            for j, qid in enumerate(ids):
                keep = np.flatnonzero(cos[:, j] >= floor[j])
                if len(keep):
                    part = best_of(left.iloc[keep].assign(score=cos[keep, j]))
                    part.insert(0, "query_id", qid)
                    parts.append(part)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return blocks.select(*cols, vector).mapInPandas(score, schema)


def vector_topk(blocks: DataFrame, queries: DataFrame, k: int, min_score: float | None = None,
                block_id: str = "block_id", vector: str = "embedding", documents: DataFrame | None = None,
                **names) -> DataFrame:
    """Exact cosine top-k blocks per query, optionally inside a document set."""
    if documents is not None:
        blocks = blocks.join(documents, "doc_id", "left_semi")
    return vector_scores(blocks, queries, block_id, vector, None, k, min_score, **names)


def match_by_vector(blocks: DataFrame, queries: DataFrame, doc_id: str = "doc_id",
                    block_id: str = "block_id", vector: str = "embedding", **names) -> DataFrame:
    """Per document the mean of its top block scores; the best documents of each query."""
    top = vector_scores(blocks, queries, block_id, vector, doc_id, BLOCKS_PER_DOC, BLOCK_MIN, **names)
    docs = top.groupBy("query_id", doc_id).agg(F.avg("score").alias("avg_score"))
    best = top_per_group(docs, ["query_id"], [F.desc("avg_score"), F.asc(doc_id)], DOCS_PER_QUERY)
    return best.where(F.col("avg_score") >= DOC_MIN)


def match_narrowed_by_vector(blocks: DataFrame, queries: DataFrame, by_name: DataFrame, doc_id: str = "doc_id", block_id: str = "block_id",
                             vector: str = "embedding") -> DataFrame:
    """``match_by_vector`` for templates (the query ids), among a template's name hits where it has any.

    ``by_name(template, doc_id)``. The candidates are kept whole per (query, document) before the narrowing, so that the best
    documents are the best ones of the narrowed set.
    """
    top = vector_scores(blocks, queries, block_id, vector, doc_id, BLOCKS_PER_DOC, BLOCK_MIN)
    docs = top.groupBy("query_id", doc_id).agg(F.avg("score").alias("avg_score")).where(F.col("avg_score") >= DOC_MIN)
    named = by_name.select(F.col("template").alias("_t"), F.col("doc_id").alias("_d")).distinct()
    some = named.select(F.col("_t").alias("_s")).distinct()
    narrowed = docs.join(named, (F.col("query_id") == F.col("_t")) & (F.col(doc_id) == F.col("_d")), "left_semi")
    free = docs.join(some, F.col("query_id") == F.col("_s"), "left_anti")
    return top_per_group(narrowed.unionByName(free), ["query_id"], [F.desc("avg_score"), F.asc(doc_id)], DOCS_PER_QUERY)


def match_cascade(docs: DataFrame, templates: Sequence[str], by_name: DataFrame,
                  by_vector: DataFrame | None, by_rules: DataFrame) -> DataFrame:
    """Matched (template, doc_id, mode): single document, vector on the narrowed set, name, rules.

    ``by_vector`` must already be restricted to ``by_name`` where a template has name hits.
    Every tier is computed once; per template the lowest tier with a result is kept.
    """
    spark = docs.sparkSession
    t = parameter_table(spark, [(x,) for x in templates], "template string")
    named = by_name.select("template").distinct().withColumn("_named", F.lit(True))
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    only = t.where(n_docs == 1).withColumn("doc_id", docs.agg(F.min("doc_id").alias("doc_id")).scalar())
    tiers = [only.select("template", "doc_id", F.lit(0).alias("tier"), F.lit("single_candidate").alias("mode"))]
    if by_vector is not None:
        v = by_vector.join(named, "template", "left")
        tiers.append(v.select(
            "template", "doc_id", F.lit(1).alias("tier"),
            F.when(F.col("_named"), "filename+vector").otherwise("vector").alias("mode")))
    tiers.append(by_name.select("template", "doc_id", F.lit(2).alias("tier"), F.lit("filename").alias("mode")))
    tiers.append(by_rules.select(
        "template", "doc_id", F.lit(3).alias("tier"),
        F.when(F.col("mode") == "fallback_all", F.col("mode")).otherwise("rules").alias("mode")))
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier)
    first = out.groupBy("template").agg(F.min("tier").alias("_first"))
    return (
        out.join(first, "template").where(F.col("tier") == F.col("_first")).drop("_first")
        .join(t, "template", "left_semi")
    )


# --- structured sources ------------------------------------------------------------------


def direct_fill_applicable(template_fields: DataFrame, blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Whether structured rows can fill a template directly: one row per template.

    Enough spreadsheet documents, every document structured, and at least 30 % of the
    template's fields among the source headers.
    """
    headers = blocks.where(F.col("headers").isNotNull()).select(F.explode("headers").alias("field")).distinct()
    structured = blocks.groupBy("doc_id").agg(F.bool_or(F.col("cells").isNotNull()).alias("_s"))
    d = docs.select("doc_id", "doc_type").join(structured, "doc_id", "left").agg(
        F.avg(F.when(F.col("doc_type").isin("xlsx", "xls", "csv") & F.coalesce("_s", F.lit(False)), 1.0)
              .otherwise(0.0)).alias("share"),
        F.bool_and(F.coalesce("_s", F.lit(False))).alias("complete"),
    )
    hit = headers.withColumn("_hit", F.lit(True))
    overlap = template_fields.join(hit, "field", "left").groupBy("template").agg(
        F.count("*").alias("n_fields"), F.count("_hit").alias("n_overlap")
    )
    share, complete = d.select("share").scalar(), d.select("complete").scalar()
    ratio = F.col("n_overlap") / F.col("n_fields")
    return overlap.select(
        "template", "n_fields", "n_overlap", F.round(ratio, 4).alias("overlap"),
        F.round(share, 4).alias("sheet_share"), complete.alias("all_structured"),
        ((ratio >= OVERLAP_MIN) & (share >= SHEET_SHARE_MIN) & complete).alias("applicable"),
    )


def map_columns(template_headers: DataFrame, source_headers: DataFrame, header_table: DataFrame) -> DataFrame:
    """Template header → source column: equal in lower case, else equal canonical name.

    ``template_headers(template, header)``, ``source_headers(header, pos)``.
    """
    low = lambda c: F.lower(text.strip(c))
    s = source_headers.select(F.col("header").alias("source_column"), "pos", low("header").alias("_low"))
    s_low = top_per_group(s, ["_low"], [F.desc("pos")])
    s_can = s.join(header_table, text.header_key("source_column") == F.col("alias_key")).select(
        "source_column", "pos", F.col("field").alias("_canon")
    )
    s_can = top_per_group(s_can, ["_canon"], [F.asc("pos")])
    t = template_headers.join(
        header_table, text.header_key("header") == F.col("alias_key"), "left"
    ).select("template", "header", F.col("field").alias("_tc"), low("header").alias("_tl"), F.lower("field").alias("_tcl"))
    a = s_low.select(F.col("_low").alias("_tcl"), F.col("source_column").alias("a"))
    b = s_low.select(F.col("_low").alias("_tl"), F.col("source_column").alias("b"))
    c = s_can.select(F.col("_canon").alias("_tc"), F.col("source_column").alias("c"))
    return (
        t.join(a, "_tcl", "left").join(b, "_tl", "left").join(c, "_tc", "left")
        .select("template", "header", F.coalesce("a", "b", "c").alias("source_column"))
        .where("source_column is not null")
    )


def guess_columns(source_headers: DataFrame, entity=fv.ENTITY_COLUMN_GUESSES, time=fv.TIME_COLUMN_GUESSES) -> DataFrame:
    """(role, source_column) for the entity and time column, first candidate name wins."""
    spark = source_headers.sparkSession
    rows = [(r, n, i) for r, names in (("entity", entity), ("time", time)) for i, n in enumerate(names)]
    guesses = small_table(spark, rows, "role string, name string, priority int", 200, "guesses")
    low = F.lower(text.strip("header"))
    hits = source_headers.join(guesses, low == F.col("name"))
    return hits.groupBy("role").agg(F.min(F.struct("priority", -F.col("pos"), "header"))["header"].alias("source_column"))
