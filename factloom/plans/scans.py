"""Queries: sources, sinks, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates, text
from factloom.operators import common, paging, profiles, selection, store
from factloom.operators.canonical import elect_canonical
from factloom.plans import fixtures as fx
from factloom.plans.registry import query
from factloom.session import dealt, materialised, scratch_path
from factloom.sources import blocks as bl


def shown_blocks(b: DataFrame) -> DataFrame:
    return b.select("doc_id", "page_or_index", "block_type", "text",
                    F.array_join("section_path", " > ").alias("section"))


@query("scan_text_blocks", f"""WITH {fx.SQL_DOCUMENTS}, {fx.sql_text_blocks()}
SELECT doc_id, page_or_index, block_type, text, section FROM blocks""")
def scan_text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return shown_blocks(bl.text_blocks(fx.documents(spark, folder)))


@query("scan_text_blocks_headed", f"{fx.DOC_BLOCKS} SELECT doc_id, page_or_index, block_type, text, section FROM blocks")
def scan_text_blocks_headed(spark: SparkSession, folder: str) -> DataFrame:
    return shown_blocks(fx.blocks(spark, folder))


# One Markdown document per order: headings, paragraphs and a pipe table of two rows.
def order_rows() -> Column:
    """Two table rows (three texts each) of an order."""
    day = F.col("o_orderdate").cast("date").cast("string")
    return F.array(
        F.array(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.col("o_orderstatus")),
        F.array(F.col("o_custkey").cast("string"), day, F.col("o_orderstatus")),
    )


SQL_ORDER_ROWS = """i AS (
  SELECT o_orderkey AS k, 1 AS n, o_orderkey || ' | ' || o_totalprice || ' | ' || o_orderstatus AS line FROM orders
  UNION ALL SELECT o_orderkey, 2, o_custkey || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || o_orderstatus FROM orders),
o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders)"""


def markdown_docs(spark: SparkSession, folder: str) -> DataFrame:
    rows = F.array_join(
        F.transform(order_rows(), lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
    text_ = F.concat(
        F.lit("# Order\nPriority "), "o_orderpriority", F.lit("\nopen\n\n### Items\n| Key | Value | Flag |\n|---|---|---|\n"),
        rows, F.lit("\n| | | |\nend of list\n## Status\n"), "o_orderstatus",
    )
    return dealt(fx.table(spark, folder, "orders")).select(
        F.col("o_orderkey").cast("string").alias("doc_id"), text_.alias("text"))


@query("scan_markdown_blocks", f"""WITH {SQL_ORDER_ROWS}, out_ AS (
  SELECT k, 1 AS x, 'heading' AS t, 'Order' AS text, 'Order' AS sec FROM o
  UNION ALL SELECT k, 2, 'paragraph', 'Priority ' || p || ' open', 'Order' FROM o
  UNION ALL SELECT k, 3, 'heading', 'Items', 'Order > Items' FROM o
  UNION ALL SELECT k, 3 + n, 'table_row', line, 'Order > Items' FROM i
  UNION ALL SELECT k, 6, 'paragraph', 'end of list', 'Order > Items' FROM o
  UNION ALL SELECT k, 7, 'heading', 'Status', 'Order > Status' FROM o
  UNION ALL SELECT k, 8, 'paragraph', s, 'Order > Status' FROM o)
SELECT CAST(k AS VARCHAR) AS doc_id, CAST(x AS INT) AS page_or_index, t AS block_type, text, sec AS section FROM out_""")
def scan_markdown_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return shown_blocks(bl.markdown_blocks(markdown_docs(spark, folder)))


# The documents have neither headings nor tables, so their twin knows paragraphs only.
@query("scan_markdown_documents", f"""WITH {fx.SQL_DOCUMENTS}, {fx.sql_lines('docs')},
islands AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM lines),
p AS (SELECT doc_id, min(line_no) AS place, string_agg(line, ' ' ORDER BY line_no) AS text FROM islands WHERE line <> '' GROUP BY doc_id, island)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INT) AS page_or_index, 'paragraph' AS block_type, text, '' AS section FROM p""")
def scan_markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    return shown_blocks(bl.markdown_blocks(fx.documents(spark, folder)))


def part_blocks(spark: SparkSession, folder: str) -> DataFrame:
    part = fx.table(spark, folder, "part")
    return bl.rows_to_blocks(
        part, "part.xlsx", "part", ["p_name", "p_brand", "p_size", "p_retailprice"], F.col("p_partkey") + 1,
        headers=["Part", "Brand", "Size", "Retail Price (USD)"])


@query("structured_rows_to_blocks", """SELECT 'part.xlsx#' || (p_partkey + 1) AS block_id, CAST(p_partkey + 1 AS INT) AS page_or_index,
 p_name || ' | ' || p_brand || ' | ' || p_size || ' | ' || p_retailprice AS text,
 'Part,Brand,Size,Retail Price (USD)' AS header_list, p_retailprice AS price FROM part""")
def structured_rows_to_blocks(spark: SparkSession, folder: str) -> DataFrame:
    b = part_blocks(spark, folder)
    price = bl.value_of("headers", "cells", F.lit("Retail Price (USD)")).cast("double")
    return b.select("block_id", "page_or_index", "text", F.array_join("headers", ",").alias("header_list"), price.alias("price"))


@query("source_routing", f"""{fx.DOC_BLOCKS}, n AS (SELECT doc_id, count(*) AS n FROM blocks WHERE text <> '' GROUP BY doc_id),
f AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS nf FROM labels GROUP BY 1)
SELECT d.doc_id, CASE WHEN n > 10 THEN 'text' WHEN nf > 0 THEN 'facts' WHEN n > 0 THEN 'text' END AS source
FROM docs d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN f ON d.doc_id = f.doc_id
WHERE n > 0 OR nf > 0 UNION ALL SELECT 'part.xlsx', 'blocks'""")
def source_routing(spark: SparkSession, folder: str) -> DataFrame:
    docs = fx.documents(spark, folder).select("doc_id").unionByName(
        part_blocks(spark, folder).select("doc_id").distinct())
    both = materialised(fx.blocks(spark, folder).drop("file_name").unionByName(part_blocks(spark, folder)), "blocks")
    labelled = fx.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("source_doc_id"))
    return store.route_sources(docs, both, labelled)


@query("source_rows", """SELECT 'part.xlsx#' || (p_partkey + 1) AS block_id,
 p_name || ' | ' || p_brand || ' | ' || p_size || ' | ' || p_retailprice AS text FROM part""")
def source_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialised(part_blocks(spark, folder), "rows")
    none = rows.select(F.col("doc_id").alias("source_doc_id")).where("false")
    routes = store.route_sources(rows.select("doc_id").distinct(), rows, none)
    return store.source_rows(rows, routes).select("block_id", "text")


@query("document_registry", f"""WITH {fx.SQL_DOCUMENTS}, b AS (SELECT *, doc_type = 'txt' AND (contains(upper(file_name), 'README')
   OR (contains(lower(text), 'prompt') AND octet_length(encode(substr(text, 1, strpos(lower(text), 'prompt') + 5))) <= 2048)) AS p FROM docs)
SELECT doc_id, file_name, doc_type, status, CASE WHEN p THEN 'prompt_instruction' ELSE 'source_document' END AS document_role,
 p AS skip_extraction FROM b""")
def document_registry(spark: SparkSession, folder: str) -> DataFrame:
    files = fx.documents(spark, folder).select(
        "doc_id", "file_name", store.first_bytes(F.col("text")).alias("head"), "status", "document_set_id")
    return store.register_documents(files).select(
        "doc_id", "file_name", "doc_type", "status", "document_role", "skip_extraction")


@query("replace_blocks", f"""{fx.DOC_BLOCKS}
SELECT block_id, doc_id, text FROM blocks WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)
UNION ALL SELECT l.doc_id || '#1', CAST(l.doc_id AS VARCHAR), d.lang || ' ' || d.source
FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1""")
def replace_blocks(spark: SparkSession, folder: str) -> DataFrame:
    old = materialised(fx.blocks(spark, folder).select("block_id", "doc_id", "text"), "blocks")
    good = fx.table(spark, folder, "labels").where("quality = 1").join(fx.table(spark, folder, "documents"), "doc_id")
    new = good.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("#1")).alias("block_id"),
        F.col("doc_id").cast("string").alias("doc_id"), F.concat_ws(" ", "lang", "source").alias("text"))
    return store.replace_blocks(old, new)


@query("upsert_rows", """WITH u AS (SELECT o_custkey AS id, o_orderkey AS v, o_orderstatus AS status,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT id, v, status FROM u WHERE rn = 1
UNION ALL SELECT c_custkey, -1, 'new' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def upsert_rows(spark: SparkSession, folder: str) -> DataFrame:
    base = fx.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("v"), F.lit("new").alias("status"))
    updates = fx.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v"), F.col("o_orderstatus").alias("status"))
    return store.upsert(base, updates, "id", "v")


@query("export_filled_cells", """SELECT o_orderstatus AS task_id, 'R' || o_orderkey AS cell_ref, o_totalprice AS value_num FROM orders""")
def export_filled_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = fx.table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("task_id"), F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("cell_ref"),
        F.col("o_totalprice").alias("value_num"))
    path = scratch_path(spark, "result")
    store.write_result(cells, path)
    return store.read_result(spark, path)


# --- filters ---------------------------------------------------------------------------

SHOWN = ["fact_id", "entity_name", "field_name", "confidence"]
SHOWN_SQL = ", ".join(SHOWN)


def elected(spark: SparkSession, folder: str) -> DataFrame:
    """The elected facts; the facts themselves are made once."""
    return elect_canonical(fx.stored_facts(spark, folder))


def stored_elected(spark: SparkSession, folder: str) -> DataFrame:
    """``elected`` as a stored table, for queries that read it more than once."""
    return materialised(elected(spark, folder), "elected")


@query("filter_facts", f"""{fx.ELECTED} SELECT {SHOWN_SQL} FROM elected WHERE field_name = 'totalprice' AND status = 'confirmed'
 AND confidence >= 0.7 AND source_doc_id IN ('orders_1996', 'orders_1998')""")
def filter_facts(spark: SparkSession, folder: str) -> DataFrame:
    f = selection.facts_query(fx.facts(spark, folder), field="totalprice", status="confirmed", min_confidence=0.7,
                              documents=["orders_1996", "orders_1998"])
    return f.select(*SHOWN)


@query("filter_facts_document_set", f"""{fx.ELECTED} SELECT {SHOWN_SQL} FROM elected WHERE is_canonical
 AND source_doc_id IN (SELECT 'orders_' || year(l_shipdate) FROM lineitem WHERE l_returnflag = 'R')""")
def filter_facts_document_set(spark: SparkSession, folder: str) -> DataFrame:
    ids = fx.table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("orders_"), F.year("l_shipdate").cast("string")).alias("doc_id")).distinct()
    return selection.facts_query(elected(spark, folder), canonical_only=True, documents=ids).select(*SHOWN)


@query("search_facts", f"""{fx.ELECTED} SELECT {SHOWN_SQL} FROM elected WHERE is_canonical AND entity_name = 'NATION_3'
 AND field_name = 'totalprice' AND year = 1997 ORDER BY confidence DESC, fact_id LIMIT 20""")
def search_facts(spark: SparkSession, folder: str) -> DataFrame:
    return selection.search_facts(elected(spark, folder), "NATION_3", "totalprice", 1997).select(*SHOWN)


@query("low_confidence_facts", f"""{fx.CUSTOMER_FACTS}, {fx.sql_elected()} SELECT {SHOWN_SQL} FROM elected WHERE is_canonical AND confidence < 0.7""")
def low_confidence_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Among facts of single customers, of which many have one weak fact only."""
    return selection.low_confidence(elect_canonical(fx.stored_facts(spark, folder, "c_name"))).select(*SHOWN)


@query("filter_documents", f"""WITH {fx.SQL_DOCUMENTS} SELECT doc_id, file_name FROM docs
 WHERE status = 'parsed' AND contains(lower(file_name), 'src1')""")
def filter_documents(spark: SparkSession, folder: str) -> DataFrame:
    return selection.list_documents(fx.documents(spark, folder), "parsed", "SRC1").select("doc_id", "file_name")


@query("filter_facts_by_date", f"""{fx.FACTS} SELECT fact_id, date FROM facts WHERE date IS NULL OR (date >= '1996-03-01' AND date <= '1997-09-30')""")
def filter_facts_by_date(spark: SparkSession, folder: str) -> DataFrame:
    f = selection.filter_by_date(fx.facts(spark, folder), "1996-03-01", "1997-09-30")
    return f.select("fact_id", F.col("metadata")["date"].alias("date"))


@query("filter_by_intent", f"""{fx.FACTS} SELECT fact_id FROM facts WHERE (date IS NULL OR (date >= '1996-01-01' AND date <= '1998-12-31'))
 AND (year IS NULL OR date IS NOT NULL OR year BETWEEN 1996 AND 1998)
 AND (contains(lower(entity_name), 'nation_1') OR contains(lower(entity_name), 'nation_7'))""")
def filter_by_intent(spark: SparkSession, folder: str) -> DataFrame:
    f = selection.intent_filter(fx.facts(spark, folder), "1996-01-01", "1998-12-31", ["NATION_1", "NATION_7"])
    return f.select("fact_id")


def raw_date() -> Column:
    """The ship date spelled in four ways, by return flag and line status."""
    day = F.col("l_shipdate")
    serial = F.datediff(day.cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    return (
        F.when(F.col("l_returnflag") == "A", F.date_format(day, "yyyy/M/d"))
        .when(F.col("l_returnflag") == "N", F.date_format(day, "yyyy'年'M'月'd'日'"))
        .when(F.col("l_linestatus") == "O", serial)
        .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    )


@query("filter_rows_by_date", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
 WHERE l_shipdate >= DATE '1996-05-01' AND l_shipdate < DATE '1997-08-16'""")
def filter_rows_by_date(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.table(spark, folder, "lineitem").withColumn("raw", raw_date())
    return selection.filter_rows_by_date(rows, "raw", "1996-05-01", "1997-08-15").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return fx.table(spark, folder, "events").withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


SQL_EVENTS = "WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events)"


@query("query_rows", f"""{SQL_EVENTS}, m AS (SELECT *, abs(CAST(substr(stamp, 12, 2) AS INT) - 9) AS d FROM e
   WHERE contains(event_type, 'click') AND contains(stamp, '2024-01-05'))
SELECT event_id, stamp FROM m WHERE d = (SELECT min(d) FROM m)""")
def query_rows(spark: SparkSession, folder: str) -> DataFrame:
    return selection.query_rows(event_rows(spark, folder), "event_type", "click", "stamp", "2024-01-05", 9).select("event_id", "stamp")


@query("block_prefilter", f"""{fx.DOC_BLOCKS} SELECT block_id FROM blocks WHERE block_type = 'heading' OR contains(text, 'the') OR contains(text, 'und')""")
def block_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    return selection.prefilter_blocks(fx.blocks(spark, folder), ["the", "und"]).select("block_id")


@query("drop_aggregate_rows", """SELECT c_custkey, name FROM (SELECT c_custkey,
   CASE WHEN c_mktsegment = 'MACHINERY' THEN ' 合计 ' WHEN c_acctbal < 0 THEN '平均' ELSE c_name END AS name FROM customer)
 WHERE trim(name) NOT IN ('合计', '平均')""")
def drop_aggregate_rows(spark: SparkSession, folder: str) -> DataFrame:
    name = F.when(F.col("c_mktsegment") == "MACHINERY", " 合计 ").when(F.col("c_acctbal") < 0, "平均").otherwise(F.col("c_name"))
    return selection.drop_aggregates(fx.table(spark, folder, "customer").select("c_custkey", name.alias("name")), "name")


@query("exact_timestamp_filter", """WITH t AS (SELECT event_type AS target, event_type AS entity, max(ts) AS stamp FROM events GROUP BY event_type)
SELECT target, event_id, value FROM events e JOIN t ON e.ts = t.stamp AND contains(e.event_type, t.entity)""")
def exact_timestamp_filter(spark: SparkSession, folder: str) -> DataFrame:
    e = fx.table(spark, folder, "events")
    targets = e.groupBy(F.col("event_type").alias("target")).agg(F.max("ts").alias("at")).withColumn("entity", F.col("target"))
    return selection.rows_at(e, "event_type", "ts", targets).select("target", "event_id", "value")


@query("select_rename_to_schema", """SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS "Name", p_retailprice AS "Price", CAST(NULL AS VARCHAR) AS "Comment" FROM part""")
def select_rename_to_schema(spark: SparkSession, folder: str) -> DataFrame:
    return selection.to_template_schema(
        fx.table(spark, folder, "part"), ["id", "Name", "Price", "Comment"],
        {"p_partkey": "id", "p_name": "Name", "p_retailprice": "Price"})


SCOPES = (("ids", None, ["1", "4", "9"]), ("set", "src3", None), ("list", "3, 7,8", None), ("all", "all", None))


@query("fallback_scope", f"""WITH {fx.SQL_DOCUMENTS}, p AS (SELECT * FROM docs WHERE status = 'parsed' AND NOT skip_extraction)
SELECT 'ids' AS request, doc_id FROM p WHERE doc_id IN ('1', '4', '9')
UNION ALL SELECT 'set', doc_id FROM p WHERE document_set_id = 'src3'
UNION ALL SELECT 'list', doc_id FROM p WHERE doc_id IN ('3', '7', '8')
UNION ALL SELECT 'all', doc_id FROM p""")
def fallback_scope(spark: SparkSession, folder: str) -> DataFrame:
    docs = materialised(fx.documents(spark, folder).drop("text"), "documents")
    out = None
    for label, set_id, ids in SCOPES:
        part = selection.resolve_documents(docs, set_id, ids).select(F.lit(label).alias("request"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("page_facts", f"""{fx.FACTS} SELECT fact_id, confidence FROM facts ORDER BY confidence DESC, fact_id LIMIT 50 OFFSET 100""")
def page_facts(spark: SparkSession, folder: str) -> DataFrame:
    return common.page(fx.facts(spark, folder), selection.fact_order(), 50, 100).select("fact_id", "confidence")


@query("page_rows_deep", """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM r WHERE k > (SELECT count(*) FROM r) / 2 AND k <= (SELECT count(*) FROM r) / 2 + 500""")
def page_rows_deep(spark: SparkSession, folder: str) -> DataFrame:
    """A page from the middle of all line items."""
    rows = fx.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    index = paging.build_page_index(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 10_000)
    return paging.page_at(index, 500, index.total // 2)


@query("page_facts_total", f"{fx.FACTS} SELECT count(*) AS total FROM facts")
def page_facts_total(spark: SparkSession, folder: str) -> DataFrame:
    return common.total(fx.facts(spark, folder))


@query("page_blocks", f"""{fx.DOC_BLOCKS}, big AS (SELECT doc_id FROM blocks GROUP BY doc_id ORDER BY count(*) DESC, doc_id LIMIT 1)
SELECT block_id, text FROM blocks WHERE doc_id = (SELECT doc_id FROM big) ORDER BY page_or_index, block_id LIMIT 5 OFFSET 2""")
def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    b = fx.blocks(spark, folder)
    big = b.groupBy("doc_id").count().orderBy(F.desc("count"), "doc_id").limit(1).select("doc_id").scalar()
    rows = b.where(F.col("doc_id") == big)
    return common.page(rows, [F.asc_nulls_last("page_or_index"), F.asc("block_id")], 5, 2).select("block_id", "text")


@query("latest_n", """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'
 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def latest_n(spark: SparkSession, folder: str) -> DataFrame:
    return common.latest(fx.table(spark, folder, "orders"), "o_orderdate", 25,
                         F.col("o_orderpriority") == "1-URGENT", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("union_sources", """SELECT s_name AS name, CAST(NULL AS VARCHAR) AS segment, s_acctbal AS balance FROM supplier
UNION ALL SELECT c_name, c_mktsegment, c_acctbal FROM customer""")
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.operators.transform import union_sources as union

    s = fx.table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = fx.table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return union([s, c])


@query("distinct_headers_in_order", """WITH h AS (SELECT unnest(['Part', 'Brand', 'Size', 'Retail Price (USD)']) AS header, unnest([0, 1, 2, 3]) AS c)
SELECT header, CAST((SELECT min(p_partkey) + 1 FROM part) AS INT) AS block_pos, CAST(c AS INT) AS col_pos FROM h""")
def distinct_headers_in_order(spark: SparkSession, folder: str) -> DataFrame:
    h = profiles.distinct_headers(part_blocks(spark, folder), F.col("page_or_index"))
    return h.select("header", F.col("first_pos.p").alias("block_pos"), F.col("first_pos.c").alias("col_pos"))


@query("distinct_values_in_order", """SELECT s AS value, min(p_partkey) AS first_pos FROM (
 SELECT regexp_replace(trim(p_type) || '市', '[市县区]+$', '') AS s, p_partkey FROM part) GROUP BY s""")
def distinct_values_in_order(spark: SparkSession, folder: str) -> DataFrame:
    part = fx.table(spark, folder, "part").withColumn("city", F.concat("p_type", F.lit("市")))
    return profiles.distinct_values(part, "city", F.col("p_partkey"))


@query("field_set_algebra", """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0),
b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'both' AS how, k FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'only_left', k FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def field_set_algebra(spark: SparkSession, folder: str) -> DataFrame:
    from factloom.operators.transform import set_algebra

    a = fx.table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    b = fx.table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"))
    both = set_algebra(a, b, "intersect").select(F.lit("both").alias("how"), "k")
    return both.unionByName(set_algebra(a, b, "subtract").select(F.lit("only_left").alias("how"), "k"))


@query("nearest_hour_match", f"""{SQL_EVENTS}, t AS (SELECT event_type AS target, strftime(max(ts), '%Y-%m-%d') AS date, 12 AS hour FROM events GROUP BY event_type),
p AS (SELECT t.target, event_id, stamp, abs(CAST(substr(stamp, 12, 2) AS INT) - hour) AS d FROM e JOIN t ON substr(stamp, 1, 10) = t.date AND e.event_type = t.target)
SELECT target, event_id, stamp FROM p WHERE d = (SELECT min(d) FROM p q WHERE q.target = p.target)""")
def nearest_hour_match(spark: SparkSession, folder: str) -> DataFrame:
    e = materialised(event_rows(spark, folder), "events")
    targets = e.groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("date")).select(
        F.col("event_type").alias("target"), "event_type", "date", F.lit(12).alias("hour"))
    return selection.nearest_hour_targets(e, "stamp", targets, ["event_type"]).select("target", "event_id", "stamp")


@query("nearest_hour_single", f"""{SQL_EVENTS}, m AS (SELECT event_id, abs(CAST(substr(stamp, 12, 2) AS INT) - 3) AS d FROM e WHERE contains(stamp, '2024-01-09'))
SELECT event_id FROM m WHERE d = (SELECT min(d) FROM m)""")
def nearest_hour_single(spark: SparkSession, folder: str) -> DataFrame:
    return selection.nearest_hour(event_rows(spark, folder), "stamp", "2024-01-09", 3).select("event_id")
