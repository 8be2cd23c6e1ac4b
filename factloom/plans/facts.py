"""Queries: extraction, election, review, lineage, aggregation of facts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import canonical, extraction, lineage, profiles, transform
from factloom.plans import fixtures as fx
from factloom.plans.registry import query
from factloom.plans.scans import elected, part_blocks, stored_elected
from factloom.session import dealt, materialised
from factloom.sources import blocks as bl

ORDER_HEADERS = ["Customer", "Order Date", "Total Price (USD)", "Priority"]


def order_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as spreadsheet rows."""
    cust = fx.table(spark, folder, "customer").select("c_custkey", "c_name")
    orders = dealt(fx.table(spark, folder, "orders")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.withColumn("day", F.col("o_orderdate").cast("date"))
    return bl.rows_to_blocks(rows, "orders.xlsx", "orders", ["c_name", "day", "o_totalprice", "o_orderpriority"],
                             F.col("o_orderkey") + 1, ORDER_HEADERS).withColumn("file_name", F.lit("orders.xlsx"))


def table_facts(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_table_facts(order_blocks(spark, folder), fx.VOCAB)


SQL_TABLE_FACTS = """WITH o AS (SELECT *, 'orders.xlsx#' || (o_orderkey + 1) AS block,
  strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN customer ON o_custkey = c_custkey),
facts AS (
  SELECT block || '|3' AS fact_id, 'customer' AS entity_type, c_name AS entity_name, 'totalprice' AS field_name,
    o_totalprice AS value_num, CAST(o_totalprice AS VARCHAR) AS value_text, 'USD' AS unit, block AS source_block_id,
    'orders.xlsx' AS source_doc_id, CAST(0.95 AS DOUBLE) AS confidence, date, 3 AS pos, CAST(NULL AS INT) AS year, 'confirmed' AS status FROM o
  UNION ALL
  SELECT block || '|4', 'generic', c_name, 'Priority', CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), o_orderpriority, NULL, block,
    'orders.xlsx', CAST(0.95 AS DOUBLE), date, 4, NULL, 'confirmed' FROM o)"""
FACT_SHOWN = ["fact_id", "entity_type", "entity_name", "field_name", "value_num", "value_text", "unit", "confidence"]


@query("extract_table_facts", f"{SQL_TABLE_FACTS} SELECT {', '.join(FACT_SHOWN)}, date FROM facts")
def extract_table_facts(spark: SparkSession, folder: str) -> DataFrame:
    return table_facts(spark, folder).select(*FACT_SHOWN, F.col("metadata")["date"].alias("date"))


SQL_TEXT_FACTS = f"""WITH {fx.SQL_CUSTOMER_TEXT}, c AS (SELECT *, replace(text, '年 ', '年') AS body FROM sentences),
spans AS (
  SELECT doc_id || '#1|t|0' AS fact_id, nation, 'totalprice' AS field_name, o_totalprice AS value_num, body, y,
    strpos(body, 'total price') - 1 AS s, 11 AS n FROM c
  UNION ALL SELECT doc_id || '#1|t|1', nation, 'acctbal', c_acctbal * 1000.0, body, y, strpos(body, 'balance') - 1, 7 FROM c)"""
TEXT_SHOWN = ["fact_id", "entity_name", "field_name", "value_num", "value_text", "unit", "year", "confidence", "status"]
SQL_TEXT_SELECT = """SELECT fact_id, nation AS entity_name, field_name, value_num,
  trim(substr(body, CAST(greatest(s - 24, 0) + 1 AS INT), CAST(least(length(body), s + n + 24) - greatest(s - 24, 0) AS INT))) AS value_text,
  'USD' AS unit, y AS year, CAST(0.88 AS DOUBLE) AS confidence, 'confirmed' AS status FROM spans"""


def text_fact_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return bl.text_blocks(fx.customer_text(spark, folder), keep=("file_name",))


@query("extract_text_facts", f"{SQL_TEXT_FACTS} {SQL_TEXT_SELECT}")
def extract_text_facts(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_text_facts(text_fact_blocks(spark, folder), fx.VOCAB).select(*TEXT_SHOWN)


@query("dedupe_facts", f"""{fx.FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_name, field_name, status, source_doc_id
   ORDER BY confidence DESC, pos) AS rn FROM facts) SELECT fact_id, confidence FROM r WHERE rn = 1""")
def dedupe_facts(spark: SparkSession, folder: str) -> DataFrame:
    coarse = fx.facts(spark, folder).withColumn("value_text", F.col("status")).withColumn(
        "source_block_id", F.col("source_doc_id"))
    return extraction.dedupe_facts(coarse).select("fact_id", "confidence")


@query("extracted_and_elected", f"""{SQL_TABLE_FACTS}, {fx.sql_elected()}
SELECT fact_id, entity_name, field_name, value_num, is_canonical FROM elected""")
def extracted_and_elected(spark: SparkSession, folder: str) -> DataFrame:
    """The minimum slice: rows → facts → deduplicated → elected."""
    facts = materialised(extraction.dedupe_facts(table_facts(spark, folder)), "facts")
    return canonical.elect_canonical(facts).select("fact_id", "entity_name", "field_name", "value_num", "is_canonical")


GROUP_SQL = "entity_type || '::' || entity_name || '::' || field_name || '::' || coalesce(CAST(year AS VARCHAR), 'None') || '::' || coalesce(unit, 'None')"


@query("canonical_facts", f"{fx.ELECTED} SELECT fact_id, is_canonical, {GROUP_SQL} AS conflict_group_id FROM elected")
def canonical_facts(spark: SparkSession, folder: str) -> DataFrame:
    return elected(spark, folder).select("fact_id", "is_canonical", "conflict_group_id")


@query("canonical_incremental", f"{fx.ELECTED} SELECT fact_id, is_canonical FROM elected")
def canonical_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of one status arrive late; the outcome must equal the full election."""
    facts = fx.stored_facts(spark, folder)
    late = (F.col("confidence") == 0.88) & (F.col("field_name") == "totalprice")
    store = materialised(canonical.elect_canonical(facts.where(~late)), "store")
    return canonical.elect_affected(store, facts.where(late)).select("fact_id", "is_canonical")


@query("review_fact", f"""{fx.FACTS}, rev AS (SELECT 'o' || l_orderkey AS fact_id, CASE WHEN l_linestatus = 'O' THEN 'rejected' ELSE 'confirmed' END AS st,
   l_returnflag AS reviewer, strftime(l_shipdate, '%Y-%m-%d') || ' ' || l_linenumber AS reviewed_at FROM lineitem WHERE l_returnflag = 'R'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY reviewed_at DESC, st DESC) AS rn FROM rev) WHERE rn = 1),
base AS (SELECT f.* REPLACE (coalesce(st, status) AS status), reviewer, reviewed_at FROM facts f LEFT JOIN last USING (fact_id)),
{fx.sql_elected('base')}
SELECT fact_id, status, is_canonical, reviewer, reviewed_at, date FROM elected""")
def review_fact(spark: SparkSession, folder: str) -> DataFrame:
    reviews = fx.table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("fact_id"),
        F.when(F.col("l_linestatus") == "O", "rejected").otherwise("confirmed").alias("status"),
        F.col("l_returnflag").alias("reviewer"), F.lit(None).cast("string").alias("note"),
        F.concat_ws(" ", F.col("l_shipdate").cast("date").cast("string"), F.col("l_linenumber").cast("string")).alias("reviewed_at"))
    out = canonical.apply_reviews(stored_elected(spark, folder), reviews)
    meta = F.col("metadata")
    return out.select("fact_id", "status", "is_canonical", meta["reviewer"].alias("reviewer"),
                      meta["reviewed_at"].alias("reviewed_at"), meta["date"].alias("date"))


@query("cascade_delete", f"""{fx.FACTS}, base AS (SELECT * FROM facts WHERE source_doc_id NOT IN ('orders_1997', 'supplier')), {fx.sql_elected('base')}
SELECT 'fact' AS kind, fact_id AS id, is_canonical FROM elected
UNION ALL SELECT DISTINCT 'document', source_doc_id, NULL FROM base
UNION ALL SELECT 'block', source_block_id, NULL FROM base""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    facts = stored_elected(spark, folder)
    docs = facts.select(F.col("source_doc_id").alias("doc_id")).distinct()
    blocks = facts.select(F.col("source_doc_id").alias("doc_id"), F.col("source_block_id").alias("block_id"))
    ids = docs.where(F.col("doc_id").isin("orders_1997", "supplier"))
    d, b, f = canonical.delete_documents(docs, blocks, facts, ids)
    none = F.lit(None).cast("boolean").alias("is_canonical")
    return (
        f.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), "is_canonical")
        .unionByName(d.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), none))
        .unionByName(b.select(F.lit("block").alias("kind"), F.col("block_id").alias("id"), none))
    )


@query("provenance_trace", f"""{fx.FACTS}
SELECT f.fact_id, f.source_doc_id || '.csv' AS file_name, f.source_span AS block_text, l_returnflag AS task_id, 'R' || l_linenumber AS cell_ref
FROM facts f LEFT JOIN lineitem ON f.fact_id = 'o' || l_orderkey""")
def provenance_trace(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.stored_facts(spark, folder)
    docs = facts.select(F.col("source_doc_id").alias("doc_id")).distinct().withColumn(
        "file_name", F.concat("doc_id", F.lit(".csv")))
    blocks = facts.select(F.col("source_doc_id").alias("doc_id"), F.col("source_block_id").alias("block_id"),
                          F.col("source_span").alias("text"), F.lit("table_row").alias("block_type"))
    cells = fx.table(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("fact_id"), F.col("l_returnflag").alias("task_id"),
        F.lit("s1").alias("sheet_name"), F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("cell_ref"))
    return lineage.provenance_trace(facts, docs, blocks, cells).select(
        "fact_id", "file_name", "block_text", "task_id", "cell_ref")


@query("evidence_columns", f"""{fx.FACTS} SELECT fact_id, 'rule' AS method, source_span AS evidence, date FROM facts""")
def evidence_columns(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("metadata")
    return lineage.with_evidence(fx.facts(spark, folder), "rule").select(
        "fact_id", m["extraction_method"].alias("method"), m["evidence_text"].alias("evidence"), m["date"].alias("date"))


# --- extractors ------------------------------------------------------------------------

REPORTED = re.compile(r"年\s?(\w+) reported a (total price) of (\S+) (\w+) on (\S+),")


def sentence_extractor(chunks: pd.DataFrame) -> pd.DataFrame:
    """A user-supplied extractor: value and day of each reported sentence."""
    rows = []
    for doc_id, block_id, text in zip(chunks["doc_id"], chunks["block_id"], chunks["text"]):
        for nation, field, value, unit, day in REPORTED.findall(text):
            rows.append((doc_id, block_id, nation, field, value, unit, text))
            rows.append((doc_id, block_id, nation, "reported day", day, None, text))
    names = ["doc_id", "block_id", "entity_name", "field_name", "value", "unit", "evidence"]
    return pd.DataFrame(rows, columns=names)


HOOK_SHOWN = ["pos", "source_block_id", "entity_name", "field_name", "value_num", "value_text", "unit", "confidence", "status"]


@query("extractor_hook", f"""WITH {fx.SQL_CUSTOMER_TEXT}
SELECT 1 * 1048576 AS pos, doc_id || '#1' AS source_block_id, nation AS entity_name, 'totalprice' AS field_name, o_totalprice AS value_num,
  CAST(o_totalprice AS VARCHAR) AS value_text, 'USD' AS unit, CAST(0.75 AS DOUBLE) AS confidence, 'pending_review' AS status FROM sentences
UNION ALL SELECT 1 * 1048576 + 1, doc_id || '#1', nation, 'reported day', CAST(y AS DOUBLE), day, NULL, CAST(0.75 AS DOUBLE), 'pending_review' FROM sentences""")
def extractor_hook(spark: SparkSession, folder: str) -> DataFrame:
    out = extraction.run_extractor(text_fact_blocks(spark, folder), sentence_extractor, fx.VOCAB, "fallback")
    return out.select(*HOOK_SHOWN)


@query("gap_fill_extraction", f"""{SQL_TEXT_FACTS}
SELECT split_part(fact_id, '|', 1) AS source_block_id, field_name, value_num, CAST(0.88 AS DOUBLE) AS confidence, 'rule' AS method FROM spans WHERE y BETWEEN 1996 AND 1998
UNION ALL SELECT doc_id || '#1', 'reported day', CAST(y AS DOUBLE), CAST(0.92 AS DOUBLE), 'intent' FROM c""")
def gap_fill_extraction(spark: SparkSession, folder: str) -> DataFrame:
    required = spark.createDataFrame(
        [("totalprice", False), ("acctbal", False), ("reported day", False), ("share", True)], "field string, is_computed boolean")
    out = extraction.extract_by_intent(text_fact_blocks(spark, folder), fx.VOCAB, required, sentence_extractor,
                                       "1996-01-01", "1998-12-31")
    return out.select("source_block_id", "field_name", "value_num", "confidence",
                      F.col("metadata")["extraction_method"].alias("method"))


@query("missing_fields", f"""{fx.FACTS}, req AS (SELECT unnest(['totalprice', 'quantity', 'discount', 'share']) AS field, unnest([false, false, false, true]) AS c)
SELECT field FROM req WHERE NOT c AND field NOT IN (SELECT field_name FROM facts)""")
def missing_fields(spark: SparkSession, folder: str) -> DataFrame:
    required = spark.createDataFrame(
        [("totalprice", False), ("quantity", False), ("discount", False), ("share", True)], "field string, is_computed boolean")
    return extraction.missing_fields(required, fx.facts(spark, folder))


# --- aggregation -----------------------------------------------------------------------


@query("row_groups", f"""{SQL_TABLE_FACTS} SELECT source_block_id, any_value(entity_name) AS entity_name,
  max(CASE WHEN field_name = 'Priority' THEN CAST(value_num AS VARCHAR) END) AS priority,
  max(CASE WHEN field_name = 'totalprice' THEN CAST(value_num AS VARCHAR) END) AS total, count(*) AS n FROM facts GROUP BY source_block_id""")
def row_groups(spark: SparkSession, folder: str) -> DataFrame:
    g = transform.row_groups(table_facts(spark, folder))
    values = F.col("field_values")
    return g.select("source_block_id", "entity_name", values["Priority"].alias("priority"),
                    values["totalprice"].alias("total"), F.size(values).alias("n"))


@query("entity_pivot", f"""{fx.CUSTOMER_FACTS} SELECT entity_name AS entity,
  arg_max(CAST(value_num AS VARCHAR), pos) FILTER (WHERE field_name = 'acctbal') AS acctbal,
  arg_max(CAST(value_num AS VARCHAR), pos) FILTER (WHERE field_name = 'totalprice') AS totalprice FROM facts GROUP BY entity_name""")
def entity_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return transform.entity_pivot(fx.facts(spark, folder, "c_name"), ["acctbal", "totalprice"])


@query("unique_entities", f"""{fx.CUSTOMER_FACTS} SELECT entity_name, min(pos) AS first_pos FROM facts GROUP BY entity_name
HAVING bool_or(field_name = 'totalprice')""")
def unique_entities(spark: SparkSession, folder: str) -> DataFrame:
    return transform.unique_entities(fx.facts(spark, folder, "c_name"), ["totalprice"])


def fact_documents(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = facts.select(F.col("source_doc_id").alias("doc_id")).distinct().withColumn(
        "file_name", F.concat("doc_id", F.lit(".csv")))
    blocks = facts.select(
        F.col("source_doc_id").alias("doc_id"), F.col("source_block_id").alias("block_id"), F.col("source_span").alias("text"),
        F.lit("paragraph").alias("block_type"), F.col("pos").alias("page_or_index"), F.lit(None).cast("array<string>").alias("cells"))
    return docs, blocks


@query("document_cards", f"""{fx.ELECTED}, b AS (SELECT *, row_number() OVER (PARTITION BY source_doc_id ORDER BY pos, source_block_id) AS k FROM facts)
SELECT doc.source_doc_id AS doc_id, doc.source_doc_id || '.csv' AS file_name,
  (SELECT count(*) FROM elected e WHERE e.source_doc_id = doc.source_doc_id AND is_canonical) AS fact_count,
  (SELECT count(*) FROM facts e WHERE e.source_doc_id = doc.source_doc_id) AS block_count,
  (SELECT count(DISTINCT field_name) FROM elected e WHERE e.source_doc_id = doc.source_doc_id AND is_canonical) AS n_fields,
  (SELECT count(DISTINCT entity_name) FROM elected e WHERE e.source_doc_id = doc.source_doc_id AND is_canonical) AS n_entities,
  (SELECT string_agg(substr(source_span, 1, 120), chr(10) ORDER BY k) FROM b WHERE b.source_doc_id = doc.source_doc_id AND k <= 4) AS text_preview
FROM (SELECT DISTINCT source_doc_id FROM facts) doc""")
def document_cards(spark: SparkSession, folder: str) -> DataFrame:
    facts = stored_elected(spark, folder)
    docs, blocks = fact_documents(facts)
    return profiles.document_cards(docs, blocks, facts)


@query("document_terms", f"""{fx.ELECTED} SELECT DISTINCT source_doc_id AS doc_id, 'field' AS kind, field_name AS term FROM elected WHERE is_canonical
UNION ALL SELECT DISTINCT source_doc_id, 'entity', entity_name FROM elected WHERE is_canonical""")
def document_terms(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.document_terms(elected(spark, folder))


@query("document_stats", f"""{fx.DOC_BLOCKS}, f AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS n FROM labels GROUP BY 1),
b AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id)
SELECT coalesce(b.doc_id, f.doc_id) AS doc_id, coalesce(b.n, 0) AS block_count, 0 AS structured_count, coalesce(b.n, 0) AS text_count, coalesce(f.n, 0) AS fact_count
FROM b FULL JOIN f ON b.doc_id = f.doc_id UNION ALL SELECT 'part.xlsx', count(*), count(*), 0, 0 FROM part""")
def document_stats(spark: SparkSession, folder: str) -> DataFrame:
    blocks = fx.blocks(spark, folder).drop("file_name").unionByName(part_blocks(spark, folder))
    labelled = fx.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("source_doc_id"))
    return profiles.document_stats(blocks, labelled)


def priced_items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the nation and region of their supplier."""
    t = lambda n: fx.table(spark, folder, n)
    place = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("lineitem").join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("n_name").alias("nation"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount_rate"),
        F.col("r_name").alias("continent"), F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").cast("date").cast("string").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


SQL_ITEMS = """WITH items AS (SELECT n_name AS nation, l_quantity AS quantity, l_discount AS discount_rate, r_name AS continent,
  l_returnflag AS flag, strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ITEM_ORDER = ("day", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
ITEM_COLS = ("nation", "quantity", "discount_rate", "continent", "flag")
SQL_FIRST_FLAG = "arg_min(flag, (day, l_orderkey, l_linenumber, l_partkey, l_extendedprice))"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("discount_rate", F.round("discount_rate", 9))


@query("name_driven_rollup", f"""{SQL_ITEMS} SELECT nation, sum(quantity) AS quantity, round(avg(discount_rate), 9) AS discount_rate,
  min(continent) AS continent, {SQL_FIRST_FLAG} AS flag FROM items GROUP BY nation""")
def name_driven_rollup(spark: SparkSession, folder: str) -> DataFrame:
    items = priced_items(spark, folder).withColumn("ord", F.struct(*ITEM_ORDER)).select(*ITEM_COLS, "ord")
    return rounded(transform.rollup_by_name(items, "nation", F.col("ord")).drop("ord"))


@query("parent_rollup", f"""{SQL_ITEMS} SELECT continent AS nation, sum(quantity) AS quantity, round(avg(discount_rate), 9) AS discount_rate,
  min(continent) AS continent, {SQL_FIRST_FLAG} AS flag FROM items GROUP BY continent""")
def parent_rollup(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: fx.table(spark, folder, n)
    parents = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    items = priced_items(spark, folder).withColumn("ord", F.struct(*ITEM_ORDER)).select(*ITEM_COLS, "ord")
    return rounded(transform.rollup_to_parent(items, "nation", parents, "ord"))


@query("date_range_rollup", f"""{SQL_ITEMS} SELECT nation, sum(quantity) AS quantity, round(avg(discount_rate), 9) AS discount_rate
FROM items WHERE day >= '1996-01-01' AND day <= '1997-06-30' GROUP BY nation""")
def date_range_rollup(spark: SparkSession, folder: str) -> DataFrame:
    items = priced_items(spark, folder).select("nation", "quantity", "discount_rate", "day")
    return rounded(transform.rollup_range(items, "day", "1996-01-01", "1997-06-30", "nation", F.lit(1)))


@query("rollup_union_sources", f"""{SQL_ITEMS} SELECT continent AS nation, sum(quantity) AS quantity FROM items GROUP BY continent
UNION ALL SELECT n_name, CAST(NULL AS DOUBLE) FROM nation""")
def rollup_union_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Children rolled up to the parent, united with a structured source."""
    rolled = parent_rollup(spark, folder).select("nation", "quantity")
    return transform.union_sources([rolled, fx.table(spark, folder, "nation").select(F.col("n_name").alias("nation"))])


SQL_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct,
  CASE WHEN count(DISTINCT {c}) BETWEEN 2 AND 30 THEN array_to_string(list_slice(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), 1, 15), ', ') END AS "values" FROM part"""
    for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


@query("table_profile", SQL_PROFILE)
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.table_profile(fx.table(spark, folder, "part")).drop("type", "exact")


SQL_SKETCHED = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS non_null, CASE WHEN count(DISTINCT {c}) <= 30 THEN count(DISTINCT {c}) END AS n_distinct, true AS near,
  CASE WHEN count(DISTINCT {c}) BETWEEN 2 AND 30 THEN array_to_string(list_slice(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), 1, 15), ', ') END AS "values" FROM lineitem"""
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"))


@query("table_profile_sketched", SQL_SKETCHED)
def table_profile_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Line items by sketches: small columns exact, the estimates of the others within 6 % of the exact count."""
    rows = fx.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    told = profiles.table_profile(rows, sketch=True)
    exact = rows.agg(*(F.count_distinct(c).alias(c) for c in rows.columns)).select(F.inline(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(c).alias("_n")) for c in rows.columns))))
    near = F.abs(F.col("n_distinct") - F.col("_n")) <= 0.06 * F.col("_n")
    return told.join(exact, "column").select("column", "rows", "non_null", F.when(F.col("exact"), F.col("n_distinct")).alias("n_distinct"), near.alias("near"), "values")


@query("left_enrich_merge", """SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders LEFT JOIN
 (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def left_enrich_merge(spark: SparkSession, folder: str) -> DataFrame:
    main = fx.table(spark, folder, "orders").withColumnRenamed("o_custkey", "key")
    extra = fx.table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    return transform.enrich(main, extra, "key").select("o_orderkey", "o_totalprice", "c_mktsegment")


@query("city_record_join", """WITH last AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey)
SELECT c_name || '市' AS city, o_totalprice AS value FROM customer LEFT JOIN last ON c_custkey = o_custkey LEFT JOIN orders ON o_orderkey = k""")
def city_record_join(spark: SparkSession, folder: str) -> DataFrame:
    cust = fx.table(spark, folder, "customer")
    template = cust.select(F.concat("c_name", F.lit("市")).alias("city"))
    records = fx.table(spark, folder, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("city"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return transform.fill_from_records(template, records, "city", "o_orderkey")


@query("merge_known_documents", f"""WITH {fx.SQL_DOCUMENTS}, a AS (SELECT doc_id, status, file_name FROM docs),
b AS (SELECT doc_id, 'uploaded' AS status, upper(file_name) AS file_name FROM docs WHERE lang IN ('en', 'de')
  UNION ALL SELECT 'new ' || doc_id, 'uploaded', file_name FROM docs WHERE lang NOT IN ('en', 'de'))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.status, b.status) AS status, coalesce(b.file_name, a.file_name) AS file_name
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def merge_known_documents(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.operators.store import merge_known

    docs = fx.documents(spark, folder)
    known = F.col("lang").isin("en", "de")
    b = docs.select(
        F.when(known, F.col("doc_id")).otherwise(F.concat(F.lit("new "), "doc_id")).alias("doc_id"), F.lit("uploaded").alias("status"),
        F.when(known, F.upper("file_name")).otherwise(F.col("file_name")).alias("file_name"))
    return merge_known(docs.select("doc_id", "status", "file_name"), b)


@query("resolve_by_name", f"""WITH {fx.SQL_DOCUMENTS}, r AS (SELECT unnest(['src3_23.txt', 'src1', 'copy of src0_0.docx', 'unknown']) AS request),
s AS (SELECT request, file_name, pos, CASE WHEN request = file_name THEN 1 WHEN contains(file_name, request) OR contains(request, file_name) THEN 2 ELSE 3 END AS tier FROM r, docs),
k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY tier, pos) AS rn FROM s)
SELECT request, file_name, pos, tier FROM k WHERE rn = 1""")
def resolve_by_name(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.operators.store import resolve_by_name as resolve

    return resolve(fx.documents(spark, folder), ["src3_23.txt", "src1", "copy of src0_0.docx", "unknown"])


@query("basic_clean", """SELECT CAST(p_partkey AS BIGINT) AS key, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS BIGINT) AS size,
  CAST(p_size + 1 AS BIGINT) AS size_1, strftime(DATE '1899-12-30' + CAST(40000 + p_size AS INT), '%Y-%m-%d') AS made_date, p_brand AS brand FROM part""")
def basic_clean(spark: SparkSession, folder: str) -> DataFrame:
    part = fx.table(spark, folder, "part")
    raw = part.select(
        F.col("p_partkey").cast("string"), F.concat(F.lit(" "), F.col("p_retailprice").cast("string")),
        F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string"), (F.col("p_size") + 40000).cast("string"), "p_brand",
    ).toDF("key", "price", "size", "size", "made_date", "brand")
    blank = raw.select(*[F.lit(None).cast("string").alias(f"x{i}") for i in range(6)]).toDF(*raw.columns)
    return transform.basic_clean(raw.union(blank))
