"""Facts, documents, blocks and templates derived from the given tables, with SQL twins.

Everything is derived from whole tables, so the work of every query grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import dealt, materialised, spread
from factloom.sources.blocks import text_blocks
from factloom.sources.vocabulary import Field, Vocabulary

VOCAB = Vocabulary(
    fields=(
        Field("acctbal", "USD", "customer", ("account balance", "balance")),
        Field("totalprice", "USD", "customer", ("total price", "order value")),
        Field("quantity", "", "item", ("quantity", "qty")),
        Field("retailprice", "USD", "item", ("retail price",)),
        Field("discount", "%", "item", ("discount rate",)),
    ),
    names=tuple(f"NATION{i}" for i in range(25)),
    factors=(
        ("totalprice", "kUSD", "USD", 1000.0, 1.0),
        ("acctbal", "kUSD", "USD", 1000.0, 1.0),
        ("retailprice", "cent", "USD", 1.0, 100.0),
    ),
    entity_headers=("customer", "nation", "part"),
    date_headers=("order date", "ship date"),
    cell_units=("kUSD", "USD", "cent", "%"),
    prose_units=("kUSD", "USD", "cent", "%"),
    entity_required=("customer",),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def case_of(c: Column, pairs, default) -> Column:
    out = None
    for key, value in pairs:
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(default)


SEGMENT_CONFIDENCE = (("AUTOMOBILE", 0.95), ("BUILDING", 0.86), ("FURNITURE", 0.72), ("HOUSEHOLD", 0.65))
SEGMENT_STATUS = (("MACHINERY", "rejected"), ("BUILDING", "pending_review"))
STATUS_CONFIDENCE = (("F", 0.92), ("O", 0.88))
PRIORITY_STATUS = (("5-LOW", "rejected"), ("4-NOT SPECIFIED", "pending_review"))


def sql_case(c: str, pairs, default) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    whens = " ".join(f"WHEN {c} = '{k}' THEN {lit(v)}" for k, v in pairs)
    return f"CASE {whens} ELSE {lit(default)} END"


def facts(spark: SparkSession, folder: str, entity: str = "n_name") -> DataFrame:
    """Account balances of customers and suppliers and values of orders as facts."""
    t = lambda n: table(spark, folder, n)
    nation = t("nation").select("n_nationkey", "n_name")
    cust = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    no_meta = F.create_map().cast("map<string,string>")
    a = cust.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("fact_id"),
        F.lit("customer").alias("entity_type"), F.col(entity).alias("entity_name"),
        F.lit("acctbal").alias("field_name"), F.col("c_acctbal").alias("value_num"),
        F.col("c_acctbal").cast("string").alias("value_text"), F.lit("USD").alias("unit"),
        F.lit(None).cast("int").alias("year"), F.lit("customer").alias("source_doc_id"),
        F.concat(F.lit("customer#"), F.col("c_custkey").cast("string")).alias("source_block_id"),
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("source_span"),
        case_of(F.col("c_mktsegment"), SEGMENT_CONFIDENCE, 0.55).alias("confidence"),
        case_of(F.col("c_mktsegment"), SEGMENT_STATUS, "confirmed").alias("status"),
        no_meta.alias("metadata"), (F.col("c_custkey") * 4).alias("pos"),
    )
    supp_entity = "n_name" if entity == "n_name" else "s_name"
    b = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("fact_id"),
        F.lit("customer").alias("entity_type"), F.col(supp_entity).alias("entity_name"),
        F.lit("acctbal").alias("field_name"), F.col("s_acctbal").alias("value_num"),
        F.col("s_acctbal").cast("string").alias("value_text"), F.lit(None).cast("string").alias("unit"),
        F.lit(None).cast("int").alias("year"), F.lit("supplier").alias("source_doc_id"),
        F.concat(F.lit("supplier#"), F.col("s_suppkey").cast("string")).alias("source_block_id"),
        F.col("s_name").alias("source_span"), F.lit(0.95).alias("confidence"),
        F.lit("confirmed").alias("status"), no_meta.alias("metadata"), (F.col("s_suppkey") * 4 + 1).alias("pos"),
    )
    date = F.col("o_orderdate").cast("date").cast("string")
    c = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("fact_id"),
        F.lit("customer").alias("entity_type"), F.col(entity).alias("entity_name"),
        F.lit("totalprice").alias("field_name"), F.col("o_totalprice").alias("value_num"),
        F.col("o_totalprice").cast("string").alias("value_text"), F.lit("USD").alias("unit"),
        F.year("o_orderdate").alias("year"),
        F.concat(F.lit("orders_"), F.year("o_orderdate").cast("string")).alias("source_doc_id"),
        F.concat(F.lit("orders#"), F.col("o_orderkey").cast("string")).alias("source_block_id"),
        F.concat_ws(" ", "c_name", "o_orderpriority").alias("source_span"),
        case_of(F.col("o_orderstatus"), STATUS_CONFIDENCE, 0.6).alias("confidence"),
        case_of(F.col("o_orderpriority"), PRIORITY_STATUS, "confirmed").alias("status"),
        F.create_map(F.lit("date"), date).alias("metadata"), (F.col("o_orderkey") * 4 + 2).alias("pos"),
    )
    return a.unionByName(b).unionByName(c)


def stored_facts(spark: SparkSession, folder: str, entity: str = "n_name") -> DataFrame:
    """``facts`` as a stored table, for queries that read them more than once."""
    return materialised(facts(spark, folder, entity), "facts")


def sql_facts(entity: str = "n_name") -> str:
    """CTE body twin of ``facts`` (the metadata map is its only key, ``date``)."""
    supp = "n_name" if entity == "n_name" else "s_name"
    return f"""
  SELECT 'c' || c_custkey AS fact_id, 'customer' AS entity_type, {entity} AS entity_name, 'acctbal' AS field_name,
         c_acctbal AS value_num, CAST(c_acctbal AS VARCHAR) AS value_text, 'USD' AS unit, CAST(NULL AS INT) AS year,
         'customer' AS source_doc_id, 'customer#' || c_custkey AS source_block_id,
         c_name || ' ' || c_mktsegment AS source_span,
         {sql_case('c_mktsegment', SEGMENT_CONFIDENCE, 0.55)} AS confidence,
         {sql_case('c_mktsegment', SEGMENT_STATUS, 'confirmed')} AS status,
         CAST(NULL AS VARCHAR) AS date, c_custkey * 4 AS pos
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 's' || s_suppkey, 'customer', {supp}, 'acctbal', s_acctbal, CAST(s_acctbal AS VARCHAR), NULL, NULL,
         'supplier', 'supplier#' || s_suppkey, s_name, CAST(0.95 AS DOUBLE), 'confirmed', NULL, s_suppkey * 4 + 1
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'o' || o_orderkey, 'customer', {entity}, 'totalprice', o_totalprice, CAST(o_totalprice AS VARCHAR), 'USD',
         CAST(year(o_orderdate) AS INT), 'orders_' || year(o_orderdate), 'orders#' || o_orderkey,
         c_name || ' ' || o_orderpriority,
         {sql_case('o_orderstatus', STATUS_CONFIDENCE, 0.6)}, {sql_case('o_orderpriority', PRIORITY_STATUS, 'confirmed')},
         strftime(o_orderdate, '%Y-%m-%d'), o_orderkey * 4 + 2
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


WINNER_ORDER = "confidence DESC, (value_num IS NOT NULL) DESC, source_doc_id DESC, fact_id DESC"


def sql_elected(source: str = "facts", name: str = "elected") -> str:
    """CTE with the canonical flag of every fact."""
    return f"""{name} AS (
  SELECT f.*, (row_number() OVER (PARTITION BY entity_type, entity_name, field_name, year, unit
     ORDER BY (status = 'rejected') ASC, {WINNER_ORDER}) = 1 AND status <> 'rejected') AS is_canonical
  FROM {source} f)"""


FACTS = f"WITH facts AS ({sql_facts()})"
ELECTED = f"{FACTS}, {sql_elected()}"
CUSTOMER_FACTS = f"WITH facts AS ({sql_facts('c_name')})"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table as registered files; labels give the status."""
    t = lambda n: table(spark, folder, n)
    kind = F.when(F.col("lang") == "en", "txt").when(F.col("lang") == "de", "md").otherwise("docx")
    return spread(t("documents")).join(t("labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat_ws("", F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), kind).alias("file_name"),
        kind.alias("doc_type"), "text", "lang", "source", "n_chars",
        F.when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "parsing").otherwise("parsed").alias("status"),
        F.col("source").alias("document_set_id"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("skip_extraction"),
        F.col("doc_id").alias("pos"),
    )


KIND = "CASE WHEN lang = 'en' THEN 'txt' WHEN lang = 'de' THEN 'md' ELSE 'docx' END"
SQL_DOCUMENTS = f"""docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, source || '_' || d.doc_id || '.' || {KIND} AS file_name,
         {KIND} AS doc_type, text, lang, source, n_chars,
         CASE WHEN quality = 0 THEN 'failed' WHEN toxic = 1 THEN 'parsing' ELSE 'parsed' END AS status,
         source AS document_set_id, COALESCE(toxic, 0) = 1 AS skip_extraction, d.doc_id AS pos
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Text blocks of the whole documents table, every sentence set as a numbered section."""
    headed = documents(spark, folder).withColumn("text", F.regexp_replace("text", "[.] ", ".\n\n1.2. Part "))
    return text_blocks(headed, keep=("file_name",))


SQL_HEADED = """headed AS (SELECT doc_id,
  regexp_replace(text, '[.] ', '.' || chr(10) || chr(10) || '1.2. Part ', 'g') AS text FROM docs)"""


# RE2 spells the line ends and white space out.
SQL_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_HEADING = (
    r"^(?:[一二三四五六七八九十]+[、.．]|[0-9]{1,2}(?:\.[0-9]{1,2}){0,2}[、.．])" + SQL_SPACE + r"*([^\s].*)$"
)


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_lines(source: str, text: str = "text") -> str:
    """CTE ``lines(doc_id, line_no, line)``."""
    return f"""split AS (SELECT doc_id, regexp_split_to_array(coalesce({text}, ''), '{SQL_LINE_BREAK}') AS a FROM {source}),
lines AS (SELECT doc_id, i AS line_no, {sql_strip('a[i]')} AS line
  FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM split))"""


def sql_text_blocks(source: str = "docs", text: str = "text", prefix: str = "") -> str:
    """CTE ``blocks(doc_id, block_type, text, section, page_or_index, block_id)``: gaps and islands."""
    return f"""{sql_lines(source, text)},
marked AS (SELECT doc_id, line_no, line, regexp_matches(line, '{SQL_HEADING}') AS is_head FROM lines),
islands AS (SELECT *, sum(CASE WHEN is_head OR line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked),
pieces AS (
  SELECT doc_id, line_no AS place, 'heading' AS block_type, regexp_extract(line, '{SQL_HEADING}', 1) AS text
  FROM islands WHERE is_head
  UNION ALL
  SELECT doc_id, min(line_no), 'paragraph', string_agg(line, ' ' ORDER BY line_no)
  FROM islands WHERE NOT is_head AND line <> '' GROUP BY doc_id, island),
{prefix}blocks AS (
  SELECT doc_id, block_type, text,
    coalesce(last_value(CASE WHEN block_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INT) AS page_or_index,
    doc_id || '#' || row_number() OVER (PARTITION BY doc_id ORDER BY place) AS block_id
  FROM pieces)"""


DOC_BLOCKS = f"WITH {SQL_DOCUMENTS}, {SQL_HEADED}, {sql_text_blocks('headed')}"

HEADERS = ("Customer", "Account Balance (USD)", "Total Price")


def template_cells(spark: SparkSession, folder: str, blank: str = "none") -> DataFrame:
    """A report template: one sheet per market segment, one row per customer.

    Row = customer key + 2. ``blank``: 'none' names every customer, 'some' leaves those with
    a negative balance unnamed, 'all' has no data rows.
    """
    cust = table(spark, folder, "customer")
    sheets = cust.select(F.col("c_mktsegment").alias("sheet")).distinct()
    head = sheets.select(
        "sheet", F.lit(1).alias("row"),
        F.posexplode(F.array(*[F.lit(h) for h in HEADERS])).alias("col", "value"),
    )
    parts = head.select("sheet", "row", (F.col("col") + 1).alias("col"), "value")
    if blank != "all":
        name = F.col("c_name") if blank == "none" else F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name"))
        body = cust.select(
            F.col("c_mktsegment").alias("sheet"), (F.col("c_custkey") + 2).cast("int").alias("row"),
            F.posexplode(F.array(name, F.lit(""), F.lit(""))).alias("col", "value"),
        )
        parts = parts.unionByName(body.select("sheet", "row", (F.col("col") + 1).alias("col"), "value"))
    return parts.select(F.lit("customers").alias("template"), "sheet", "row", "col", "value")


def customer_text(spark: SparkSession, folder: str) -> DataFrame:
    """One sentence per order, for the prose rules."""
    t = lambda n: table(spark, folder, n)
    j = dealt(t("orders")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.col("o_orderdate").cast("date").cast("string")
    sentence = F.concat(
        F.lit("In "), F.year("o_orderdate").cast("string"), F.lit("年 "), F.replace(F.col("n_name"), F.lit("_"), F.lit("")),
        F.lit(" reported a total price of "), F.col("o_totalprice").cast("string"), F.lit(" USD on "), day,
        F.lit(", the balance stood at "), F.col("c_acctbal").cast("string"), F.lit(" kUSD."),
    )
    return j.select(
        F.col("o_orderkey").cast("string").alias("doc_id"), sentence.alias("text"), day.alias("day"),
        F.replace(F.col("n_name"), F.lit("_"), F.lit("")).alias("nation"), "o_totalprice", "c_acctbal", F.year("o_orderdate").alias("y"), F.lit("orders.txt").alias("file_name"),
    )


SQL_CUSTOMER_TEXT = """sentences AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS day, replace(n_name, '_', '') AS nation, o_totalprice, c_acctbal,
    CAST(year(o_orderdate) AS INT) AS y,
    'In ' || year(o_orderdate) || '年 ' || replace(n_name, '_', '') || ' reported a total price of ' || o_totalprice || ' USD on '
    || strftime(o_orderdate, '%Y-%m-%d') || ', the balance stood at ' || c_acctbal || ' kUSD.' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
