"""Queries: layout, filling, checking and scoring of templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evaluation, filling, profiles, transform
from factloom.plans import fixtures as fx
from factloom.plans.facts import ORDER_HEADERS, order_blocks
from factloom.plans.registry import query
from factloom.session import dealt, materialised

SHEET = ["template", "sheet"]


def layout(spark: SparkSession, folder: str, blank: str = "none"):
    """Cells, plan and columns of the customer template, each as a stored table."""
    cells = materialised(fx.template_cells(spark, folder, blank), "cells")
    plan, columns = filling.detect_layout(cells, fx.VOCAB)
    return cells, materialised(plan, "plan"), materialised(columns, "columns")


def customer_facts(spark: SparkSession, folder: str) -> DataFrame:
    return fx.facts(spark, folder, "c_name")


def lookup_table(spark: SparkSession, folder: str) -> DataFrame:
    return materialised(filling.fact_lookup(customer_facts(spark, folder)), "lookup")


SQL_BEST = f"""{fx.CUSTOMER_FACTS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_name, field_name ORDER BY confidence DESC, fact_id) AS rn FROM facts) WHERE rn = 1)"""
SQL_COLS = "cols AS (SELECT unnest(['acctbal', 'totalprice']) AS field, unnest([2, 3]) AS col)"
CELLS = ["sheet_name", "cell_ref", "entity_name", "field_name", "value_num", "fact_id"]


def filled_sql(rows: str) -> str:
    """Cells of ``rows(sheet, row, entity)`` joined with the best facts."""
    return f"""SELECT r.sheet AS sheet_name, chr(64 + CAST(col AS INT)) || r.row AS cell_ref, r.entity AS entity_name, cols.field AS field_name, value_num, fact_id
FROM {rows} r, cols JOIN best b ON b.entity_name = r.entity AND b.field_name = cols.field"""


@query("header_row_detection", """SELECT DISTINCT 'customers' AS template, c_mktsegment AS sheet, 1 AS row, 1 AS entity_col, 7 AS score FROM customer""")
def header_row_detection(spark: SparkSession, folder: str) -> DataFrame:
    return layout(spark, folder)[1]


@query("template_columns", """SELECT DISTINCT c_mktsegment AS sheet, unnest([2, 3]) AS col, unnest(['acctbal', 'totalprice']) AS field FROM customer""")
def template_columns(spark: SparkSession, folder: str) -> DataFrame:
    return layout(spark, folder)[2].select("sheet", "col", "field")


@query("intent_columns", """SELECT DISTINCT c_mktsegment AS sheet, unnest([2, 3]) AS col, unnest(['acctbal', 'TotalPrice']) AS field FROM customer""")
def intent_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The intent names one field canonically and the other by its cleaned header."""
    cells = fx.template_cells(spark, folder, "all")
    return filling.intent_columns(cells, ["acctbal", "TotalPrice"], fx.VOCAB).select("sheet", "col", "field")


@query("fact_lookup_join", f"""{SQL_BEST} SELECT c_custkey, field_name, fact_id, value_num FROM customer JOIN best ON entity_name = c_name""")
def fact_lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    lookup = lookup_table(spark, folder)
    name = F.when(F.col("c_acctbal") < 0, F.concat("c_name", F.lit("市"))).otherwise(F.col("c_name"))
    cells = fx.table(spark, folder, "customer").select(
        "c_custkey", name.alias("raw"), F.regexp_replace(name, "市$", "").alias("entity"),
        F.explode(F.array(F.lit("acctbal"), F.lit("totalprice"))).alias("field"))
    return filling.look_up(cells, lookup, "entity", "raw", key=("c_custkey", "field")).select(
        "c_custkey", F.col("field").alias("field_name"), "fact_id", "value_num")


@query("fill_prefilled_rows", f"""{SQL_BEST}, {SQL_COLS}, r AS (SELECT c_mktsegment AS sheet, c_custkey + 2 AS row, c_name AS entity FROM customer) {filled_sql('r')}""")
def fill_prefilled_rows(spark: SparkSession, folder: str) -> DataFrame:
    cells, plan, columns = layout(spark, folder)
    rows = filling.data_rows(cells, plan)
    filled = filling.fill_by_entity(rows, columns, lookup_table(spark, folder))
    return filling.as_cells(filled, "t1").select(*CELLS)


def sheet_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities in scope per sheet, in first-appearance order."""
    cust = fx.table(spark, folder, "customer").select(F.col("c_name").alias("entity_name"), F.col("c_mktsegment").alias("sheet"))
    seen = transform.unique_entities(customer_facts(spark, folder), ["acctbal", "totalprice"])
    return materialised(seen.join(cust, "entity_name").select(
        F.lit("customers").alias("template"), "sheet", F.col("entity_name").alias("entity"), F.col("first_pos").alias("pos")), "entities")


SQL_QUEUE = """queue AS (SELECT sheet, entity, row_number() OVER (PARTITION BY sheet ORDER BY pos) AS k FROM (
  SELECT c_mktsegment AS sheet, entity_name AS entity, min(pos) AS pos FROM facts JOIN customer ON c_name = entity_name GROUP BY 1, 2))"""


@query("fill_blank_rows", f"""{SQL_BEST}, {SQL_COLS}, {SQL_QUEUE}, r AS (SELECT sheet, 1 + k AS row, entity FROM queue) {filled_sql('r')}""")
def fill_blank_rows(spark: SparkSession, folder: str) -> DataFrame:
    _, plan, columns = layout(spark, folder, "all")
    filled = filling.fill_new_rows(plan, columns, sheet_entities(spark, folder), lookup_table(spark, folder))
    return filling.as_cells(filled, "t1").select(*CELLS)


SQL_MIXED = f"""{SQL_BEST}, {SQL_COLS}, {SQL_QUEUE},
blank AS (SELECT c_mktsegment AS sheet, c_custkey + 2 AS row, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer WHERE c_acctbal < 0),
placed AS (SELECT c_mktsegment AS sheet, c_custkey + 2 AS row, c_name AS entity FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT b.sheet, b.row, q.entity FROM blank b JOIN queue q ON b.sheet = q.sheet AND b.k = q.k),
last AS (SELECT c_mktsegment AS sheet, max(c_custkey) + 2 AS last FROM customer GROUP BY 1),
leftover AS (SELECT sheet, entity, row_number() OVER (PARTITION BY sheet ORDER BY k) AS j FROM queue q
  WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.sheet = q.sheet AND p.entity = q.entity)),
r AS (SELECT * FROM placed UNION ALL SELECT l.sheet, last + j, entity FROM leftover l JOIN last ON l.sheet = last.sheet)"""


@query("fill_mixed_rows", f"{SQL_MIXED} {filled_sql('r')}")
def fill_mixed_rows(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_cells(spark, folder).select(*CELLS)


def mixed_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells, plan, columns = layout(spark, folder, "some")
    rows = materialised(filling.data_rows(cells, plan), "rows")
    filled = filling.fill_mixed(rows, plan, columns, sheet_entities(spark, folder), lookup_table(spark, folder))
    return filling.as_cells(filled, "t1")


def order_template(spark: SparkSession, folder: str, slots: bool):
    """A template for orders: one sheet per order status, blank rows for part of the orders."""
    orders = fx.table(spark, folder, "orders")
    sheets = orders.select(F.col("o_orderstatus").alias("sheet")).distinct()
    head = sheets.select("sheet", F.lit(3).cast("int").alias("row"), F.posexplode(F.array(
        F.lit("Customer"), F.lit("Total Price (USD)"), F.lit("Quantity"))).alias("c", "value"))
    cells = head.select(F.lit("orders").alias("template"), "sheet", "row", (F.col("c") + 1).alias("col"), "value")
    if slots:
        blanks = orders.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select(
            F.lit("orders").alias("template"), F.col("o_orderstatus").alias("sheet"),
            (F.col("o_orderkey") + 4).cast("int").alias("row"), F.lit(1).alias("col"), F.lit("").alias("value"))
        cells = cells.unionByName(blanks)
    cells = materialised(cells, "cells")
    plan, columns = filling.detect_layout(cells, fx.VOCAB)
    plan = materialised(plan, "plan")
    return materialised(filling.data_rows(cells, plan), "rows"), plan, materialised(columns, "columns")


# Orders of a sheet in key order; the first ones take the blank rows, the others follow below.
SQL_ORDER_ROWS = """o AS (SELECT o_orderstatus AS sheet, c_name AS entity, o_totalprice, o_orderkey, qty,
   row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey
   LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
slots AS (SELECT o_orderstatus AS sheet, o_orderkey + 4 AS row, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k
   FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
size AS (SELECT sheet, count(*) AS n, max(row) AS last FROM slots GROUP BY sheet),
r AS (SELECT o.*, coalesce(s.row, size.last + o.k - size.n) AS row FROM o JOIN size ON o.sheet = size.sheet LEFT JOIN slots s ON s.sheet = o.sheet AND s.k = o.k)"""


def orders_with_quantity(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: fx.table(spark, folder, n)
    qty = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        qty, F.col("o_orderkey") == F.col("l_orderkey"), "left")


@query("fill_from_row_groups", f"""WITH {SQL_ORDER_ROWS.replace("WHERE o_orderpriority", "WHERE o_orderpriority").replace("LEFT JOIN (SELECT", "JOIN (SELECT")}
SELECT sheet AS sheet_name, 'B' || row AS cell_ref, entity AS entity_name, o_totalprice AS value_num FROM r
UNION ALL SELECT sheet, 'C' || row, entity, qty FROM r""")
def fill_from_row_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan, columns = order_template(spark, folder, True)
    o = materialised(orders_with_quantity(spark, folder), "orders")
    values = F.map_filter(
        F.create_map(F.lit("totalprice"), F.col("o_totalprice").cast("string"), F.lit("quantity"), F.col("qty").cast("string"),
                     F.lit("priority"), F.col("o_orderpriority")), lambda k, v: v.isNotNull())
    groups = o.select(F.lit("orders").alias("template"), F.col("o_orderstatus").alias("sheet"), F.col("c_name").alias("entity_name"),
                      values.alias("field_values"), F.col("o_orderkey").alias("pos"))
    out = filling.fill_row_groups(groups, rows, plan, columns)
    from factloom.functions.numbers import cell_ref

    return out.select(F.col("sheet").alias("sheet_name"), cell_ref(F.col("row"), F.col("col")).alias("cell_ref"),
                      F.col("entity").alias("entity_name"), "value_num")


@query("fill_direct", f"""WITH {SQL_ORDER_ROWS}
SELECT sheet AS sheet_name, 'B' || row AS cell_ref, entity AS entity_name, 'totalprice' AS field_name, o_totalprice AS value_num, 'o_totalprice=' || o_totalprice AS evidence_text FROM r
UNION ALL SELECT sheet, 'C' || row, entity, 'quantity', qty, 'qty=' || qty FROM r WHERE qty IS NOT NULL""")
def fill_direct(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan, columns = order_template(spark, folder, True)
    o = materialised(orders_with_quantity(spark, folder), "orders").select(
        F.lit("orders").alias("template"), F.col("o_orderstatus").alias("sheet"), F.col("o_orderkey").alias("pos"),
        "c_name", "o_totalprice", "qty")
    filled = filling.fill_direct(o, rows, plan, columns, {"totalprice": "o_totalprice", "quantity": "qty"}, "c_name")
    return filling.as_cells(filled, "t2").select(
        "sheet_name", "cell_ref", "entity_name", "field_name", "value_num", "evidence_text")


@query("fill_warnings", f"""{SQL_BEST}, {SQL_COLS}, r AS (SELECT c_mktsegment AS sheet, c_custkey + 2 AS row, c_name AS entity FROM customer),
f AS ({filled_sql('r')}), j AS (SELECT f.cell_ref, f.sheet_name, x.* FROM f JOIN facts x ON f.fact_id = x.fact_id)
SELECT sheet_name, cell_ref, 'negative' AS warning FROM j WHERE value_num < 0
UNION ALL SELECT sheet_name, cell_ref, 'year' FROM j WHERE year < 1950 OR year > 2030
UNION ALL SELECT sheet_name, cell_ref, 'low_confidence' FROM j WHERE confidence < 0.6""")
def fill_warnings(spark: SparkSession, folder: str) -> DataFrame:
    cells, plan, columns = layout(spark, folder)
    facts = fx.stored_facts(spark, folder, "c_name")
    filled = filling.fill_by_entity(filling.data_rows(cells, plan), columns, materialised(filling.fact_lookup(facts), "lookup"))
    return filling.fill_warnings(filling.as_cells(filled, "t1"), facts).select("sheet_name", "cell_ref", "warning")


@query("unfilled_fields", f"""{fx.CUSTOMER_FACTS} SELECT field FROM (SELECT unnest(['acctbal', 'totalprice', 'quantity']) AS field) WHERE field NOT IN (SELECT field_name FROM facts)""")
def unfilled_fields(spark: SparkSession, folder: str) -> DataFrame:
    required = spark.createDataFrame([("acctbal",), ("totalprice",), ("quantity",)], "field string")
    return filling.unfilled_fields(required, mixed_cells(spark, folder))


# --- evaluation: the actual result deviates by priority ---------------------------------------


def scored_cells(spark: SparkSession, folder: str):
    o = materialised(fx.table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority", "o_totalprice"), "scored")
    key = [F.col("o_orderstatus").alias("scenario"), F.lit("s1").alias("sheet"),
           F.concat(F.lit("B"), F.col("o_orderkey").cast("string")).alias("cell_ref")]
    p = F.col("o_orderpriority")
    price = F.col("o_totalprice")
    template = o.select(*key, F.when(p == "1-URGENT", "kept").otherwise("").alias("value"))
    reference = o.select(*key, F.format_number(price, 2).alias("value"))
    good = F.col("o_orderstatus") == "F"  # one scenario passes, the others do not
    actual = o.select(*key, F.when(p == "2-HIGH", price * 1.005).when((p == "5-LOW") & ~good, price * 1.02)
                      .when((p == "4-NOT SPECIFIED") & (~good | (F.col("o_orderkey") % 4 == 0)), F.lit(None).cast("double"))
                      .otherwise(price).cast("string").alias("value"))
    return template, reference, actual


SQL_DIFF = """d AS (SELECT o_orderstatus AS scenario, 'B' || o_orderkey AS cell_ref, o_totalprice AS price, o_orderpriority IN ('2-HIGH', '3-MEDIUM')
   OR (o_orderstatus = 'F' AND (o_orderpriority = '5-LOW' OR o_orderkey % 4 <> 0)) AS is_match
  FROM orders WHERE o_orderpriority <> '1-URGENT')"""


@query("cell_diff", f"WITH {SQL_DIFF} SELECT scenario, cell_ref, price AS expected, is_match FROM d")
def cell_diff(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.cell_diff(*scored_cells(spark, folder)).select(
        "scenario", "cell_ref", F.col("expected").cast("double").alias("expected"), "is_match")


@query("fill_accuracy", f"""WITH {SQL_DIFF} SELECT scenario, count(*) AS blanks, sum(CAST(is_match AS BIGINT)) AS correct, round(avg(CAST(is_match AS DOUBLE)), 6) AS accuracy,
  avg(CAST(is_match AS DOUBLE)) >= 0.8 AS passed FROM d GROUP BY scenario""")
def fill_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.fill_accuracy(evaluation.cell_diff(*scored_cells(spark, folder)))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("accuracy_summary", f"""WITH {SQL_DIFF}, a AS (SELECT scenario, avg(CAST(is_match AS DOUBLE)) AS acc FROM d GROUP BY scenario)
SELECT count(*) AS scenarios, round(avg(acc), 6) AS avg_accuracy, sum(CASE WHEN acc >= 0.8 THEN 1 ELSE 0 END) AS n_passed FROM a""")
def accuracy_summary(spark: SparkSession, folder: str) -> DataFrame:
    per = evaluation.fill_accuracy(evaluation.cell_diff(*scored_cells(spark, folder)))
    return evaluation.accuracy_summary(per).withColumn("avg_accuracy", F.round("avg_accuracy", 6))


# --- template profile and intent --------------------------------------------------------------


@query("template_profile", """WITH cells AS (
  SELECT c_mktsegment || '.xlsx' AS template, 1 AS row, unnest([1, 2, 3]) AS col, unnest(['Customer', 'Account Balance (USD)', 'Total Price']) AS v FROM (SELECT DISTINCT c_mktsegment FROM customer)
  UNION ALL SELECT c_mktsegment || '.xlsx', c_custkey + 2, 1, c_name FROM customer)
SELECT DISTINCT template, 'field' AS kind, CASE v WHEN 'Account Balance (USD)' THEN 'acctbal' WHEN 'Total Price' THEN 'totalprice' ELSE v END AS term FROM cells WHERE row <= 10
UNION ALL SELECT DISTINCT template, 'entity', v FROM cells WHERE col = 1 AND row > 1""")
def template_profile(spark: SparkSession, folder: str) -> DataFrame:
    cells = materialised(fx.template_cells(spark, folder).withColumn("template", F.concat("sheet", F.lit(".xlsx"))), "cells")
    plan = materialised(filling.detect_layout(cells, fx.VOCAB)[0], "plan")
    return profiles.template_profile(cells, plan, fx.VOCAB).where("kind in ('field', 'entity')")


@query("template_profile_texts", """WITH seg AS (SELECT DISTINCT c_mktsegment AS s FROM customer),
cells AS (SELECT s, 0 AS row, 0 AS col, s AS v FROM seg
  UNION ALL SELECT s, 1, unnest([1, 2, 3]), unnest(['Customer', 'Account Balance (USD)', 'Total Price']) FROM seg
  UNION ALL SELECT c_mktsegment, c_custkey + 2, 1, c_name FROM customer WHERE c_custkey + 2 <= 20)
SELECT s || '.xlsx' AS template, 'sample' AS kind, v AS term FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY row, col) AS k FROM cells) WHERE k <= 12
UNION ALL SELECT s || '.xlsx', 'keyword', unnest([s, 'Customer', 'Account', 'Balance', 'USD', 'Total', 'Price']) FROM seg""")
def template_profile_texts(spark: SparkSession, folder: str) -> DataFrame:
    cells = materialised(fx.template_cells(spark, folder).withColumn("template", F.concat("sheet", F.lit(".xlsx"))), "cells")
    plan = materialised(filling.detect_layout(cells, fx.VOCAB)[0], "plan")
    return profiles.template_profile(cells, plan, fx.VOCAB).where("kind in ('keyword', 'sample')")


@query("template_intent", """SELECT 'customers' AS template, unnest(['Customer', 'acctbal', 'totalprice']) AS field, unnest(['Customer', 'Account Balance (USD)', 'Total Price']) AS header,
  (SELECT min(c_mktsegment) FROM customer) AS sheet, unnest([1, 2, 3]) AS col""")
def template_intent(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.template_intent(materialised(fx.template_cells(spark, folder), "cells"), fx.VOCAB)


@query("requirement_constraints", """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE year(o_orderdate) || '-01-01' END AS date_from,
  CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE year(o_orderdate) || '-12-31' END AS date_to,
  n_name AS entities FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def requirement_constraints(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: fx.table(spark, folder, n)
    j = dealt(t("orders")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    when = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-M-d")).when(
        F.col("o_orderstatus") == "O", F.concat(F.year("o_orderdate").cast("string"), F.lit("年"))).otherwise("")
    req = j.select("o_orderkey", F.concat(F.lit("城市："), "n_name", F.lit("市；时间 "), when).alias("requirement"))
    return profiles.requirement_constraints(req).select(
        "o_orderkey", "date_from", "date_to", F.array_join("entities", ",").alias("entities"))


@query("order_report_scenario", """SELECT 'orders.xlsx#' || (o_orderkey + 1) AS block_id, o_totalprice AS price FROM orders
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate <= DATE '1996-08-31'""")
def order_report_scenario(spark: SparkSession, folder: str) -> DataFrame:
    """Date range + projection to a template, the epidemic-data scenario on order rows."""
    from factloom.operators import selection
    from factloom.sources.blocks import value_of

    rows = order_blocks(spark, folder).select(
        "block_id", *[value_of("headers", "cells", F.lit(h)).alias(h) for h in ORDER_HEADERS])
    inside = selection.filter_rows_by_date(rows, "Order Date", "1996-07-01", "1996-08-31")
    out = selection.to_template_schema(inside, ["block_id", "price"], {"Total Price (USD)": "price"})
    return out.withColumn("price", F.col("price").cast("double"))
