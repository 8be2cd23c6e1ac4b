"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import (
    bpe, chat, decontamination, exact_dedup, html_pages, language, lookup_kmeans, periodic_runs, quality, sharding, simhash, token_files, toxicity,
)
from factloom.llm.shared import table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
END_ID = 2
SHARDS = 16


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_digests(spark, table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), END_ID)


def op2_hash_tree_sharding(spark: SparkSession, folder: str) -> DataFrame:
    tree = sharding.even_tree(SHARDS)
    return sharding.assign_shards(table(spark, folder, "documents"), tree, sharding.grown(tree))


def op3_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


def op4_quotation_linking(spark: SparkSession, folder: str) -> DataFrame:
    return chat.reply_ordered(table(spark, folder, "conversations"))


OP4_SQL = r"""
WITH RECURSIVE messages AS (
    SELECT row_number() OVER () AS r, conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv, turn AS own_turn, coalesce(turn, CAST(1 AS BIGINT) << 60) AS turn, role,
           string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM conversations
), parsed AS (
    SELECT *, list_transform(lines, lambda x: length(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+'), '[^>]', '', 'g'))) AS levels FROM messages
), whole AS (
    SELECT *, list_max(levels) AS quote_depth, regexp_replace(array_to_string(list_transform(list_filter(list_zip(lines, levels), lambda z: z[2] = 0), lambda z: z[1]), chr(10)),
           '^\s*\n|\s+$', '', 'g') AS body FROM parsed
), lined AS (SELECT r, conv, turn, unnest(lines) AS line, unnest(levels) AS level, generate_subscripts(lines, 1) - 1 AS place FROM parsed
), units AS (
    SELECT r, conv, turn, level, place, trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '')), '\s+', ' ', 'g')) AS unit FROM lined
), edges AS (
    SELECT *, CASE WHEN lag(place) OVER w = place - 1 AND lag(level) OVER w = level THEN 0 ELSE 1 END AS opens FROM units WHERE unit <> ''
    WINDOW w AS (PARTITION BY r ORDER BY place)
), runs AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY place) AS passage FROM edges
), passages AS (
    SELECT r, conv, turn, level, passage, min(place) AS place, max(place) AS last, string_agg(unit, chr(10) ORDER BY place) AS text FROM runs GROUP BY ALL
), cut AS (
    SELECT *, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?…])(\s)', '\1' || chr(1) || '\2', 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)),
                          lambda x: x <> '') AS parts FROM passages
), sentences AS (
    SELECT *, length(sentence) - length(replace(sentence, chr(10), '')) AS feeds FROM (SELECT *, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS number FROM cut)
), spans AS (SELECT *, sum(feeds) OVER (PARTITION BY r, passage ORDER BY number) AS upto FROM sentences
), pieces AS (
    SELECT r, conv, turn, level, 0 AS kind, replace(text, chr(10), ' ') AS piece, place AS first, last FROM passages
    UNION ALL SELECT r, conv, turn, level, 1, trim(replace(sentence, chr(10), ' ')), place + upto - feeds + CAST(starts_with(sentence, chr(10)) AS INTEGER), place + upto FROM spans
    UNION ALL SELECT r, conv, turn, level, 2, unit, place, place FROM units WHERE unit <> ''
), found AS (
    SELECT *, (SELECT max(o.turn) FROM pieces o WHERE o.level = 0 AND o.conv = q.conv AND o.piece = q.piece AND o.turn < q.turn AND (q.kind = 1 OR o.kind <> 1)) AS source
    FROM pieces q WHERE q.level > 0
), links AS (
    SELECT conv, turn, level, arg_min(source, (kind, -source)) AS source
    FROM (SELECT *, unnest(generate_series(CAST(first AS BIGINT), CAST(last AS BIGINT))) AS place FROM found WHERE source IS NOT NULL) GROUP BY r, conv, turn, level, place
), votes AS (SELECT conv, turn, source, min(level) AS level, count(*) AS n FROM links WHERE source IS NOT NULL GROUP BY conv, turn, source
), parents AS (SELECT conv, turn, arg_max(source, (-level, n, source)) AS parent, CAST(sum(n) AS BIGINT) AS linked FROM votes GROUP BY conv, turn
), turns AS (SELECT *, lag(turn) OVER (PARTITION BY conv ORDER BY turn) AS before FROM (SELECT DISTINCT conv, turn FROM messages)
), opened AS (SELECT t.conv, t.turn, t.before, parent, linked, before IS NULL OR parent <> before AS opens FROM turns t LEFT JOIN parents p ON p.conv = t.conv AND p.turn = t.turn
), placed AS (SELECT *, max(CASE WHEN opens THEN turn END) OVER (PARTITION BY conv ORDER BY turn) AS start FROM opened
), heads AS (
    SELECT h.conv, h.start, p.start AS above FROM placed h LEFT JOIN placed p ON p.conv = h.conv AND p.turn = h.parent WHERE h.opens
), paths AS (
    SELECT conv, start, [start] AS path FROM heads WHERE above IS NULL
    UNION ALL SELECT h.conv, h.start, list_append(p.path, h.start) FROM heads h JOIN paths p ON p.conv = h.conv AND p.start = h.above
)
SELECT w.conv_id, row_number() OVER (PARTITION BY w.conv ORDER BY b.path, w.turn, role NULLS FIRST, body, quote_depth) - 1 AS reply_order, own_turn AS turn, role, body AS text,
       coalesce(parent, before) AS parent_turn, len(b.path) - 1 AS branch_depth, quote_depth, coalesce(linked, 0) AS linked_lines
FROM whole w JOIN placed p ON p.conv = w.conv AND p.turn = w.turn JOIN paths b ON b.conv = p.conv AND b.start = p.start
"""


def op5_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_of(table(spark, folder, "documents"))


def op7_wrapper_induction(spark: SparkSession, folder: str) -> DataFrame:
    return html_pages.extract_pages(table(spark, folder, "pages"))


def op8_progressive_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, folder, "documents"))


OP8_SQL = r"""
WITH rows AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), groups AS (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
    FROM rows
)
SELECT * FROM groups
"""


def op9_forced_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op10_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_of(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_factorisation_machine(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_of(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_lookup_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return lookup_kmeans.lookup_kmeans(table(spark, folder, "embeddings"))


def _kmeans_sql() -> str:
    """The rounds of op12 as common table expressions: one row for each vector and dimension, joined to the centroids of the round."""
    parts = [f"""kept AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({lookup_kmeans.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {lookup_kmeans.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {lookup_kmeans.DIMENSIONS}
), long AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept
), first AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {lookup_kmeans.CENTROIDS}
), c0 AS (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM first)"""]
    for n in range(lookup_kmeans.ROUNDS + 1):
        parts.append(f"""a{n} AS (
    SELECT r, arg_min(c, (s, c)) AS c, min(s) AS s FROM (SELECT r, c, CAST(sum((l.x - k.x) * (l.x - k.x)) AS BIGINT) AS s FROM long l JOIN c{n} k USING (d) GROUP BY r, c) GROUP BY r)""")
        if n < lookup_kmeans.ROUNDS:
            parts.append(f"""m{n} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM long JOIN a{n} USING (r) GROUP BY c, d
), c{n + 1} AS (SELECT k.c, k.d, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} k LEFT JOIN m{n} USING (c, d))""")
    last = lookup_kmeans.ROUNDS
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, s AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{last} GROUP BY c) USING (c)"""


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_files, op2_hash_tree_sharding, op3_simhash_trie, op4_quotation_linking, op5_string_tiling, op6_language_filters,
        op7_wrapper_induction, op8_progressive_dedup, op9_forced_bpe, op10_toxic_segments, op11_factorisation_machine,
        op12_lookup_kmeans, op13_periodic_runs)
} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {"op4_quotation_linking": OP4_SQL, "op8_progressive_dedup": OP8_SQL, "op12_lookup_kmeans": _kmeans_sql()}
