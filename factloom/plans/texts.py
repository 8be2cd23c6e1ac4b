"""Queries: text rules as columns, sequences of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates, numbers, text
from factloom.functions.udfs import register
from factloom.operators import extraction, profiles, sequence, transform
from factloom.plans import fixtures as fx
from factloom.plans.registry import query
from factloom.plans.scans import part_blocks, raw_date
from factloom.session import dealt, materialised, spread
from factloom.sources.vocabulary import Field, Vocabulary


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return spread(fx.table(spark, folder, "lineitem"))


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(fx.table(spark, folder, "documents")).select("doc_id", "text")


ITEM = ["l_orderkey", "l_linenumber", "l_partkey"]
ITEM_SQL = ", ".join(ITEM)


@query("normalize_header", "SELECT p_partkey, replace(p_name, ' ', '') AS header FROM part")
def normalize_header(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_name", F.lit(" （"), "p_brand", F.lit("） ("), "p_type")
    return fx.table(spark, folder, "part").select("p_partkey", text.normalize_header(raw).alias("header"))


@query("alias_join", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'retailprice' WHEN p_size % 3 = 1 THEN 'acctbal'
  WHEN p_size = 50 THEN NULL ELSE p_brand END AS field FROM part""")
def alias_join(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("p_size") % 3
    raw = (
        F.when(kind == 0, F.concat(F.lit("Retail Price ("), "p_type", F.lit(")"))).when(kind == 1, " Account Balance")
        .when(F.col("p_size") == 50, "50").otherwise(F.concat("p_brand", F.lit(" (x)")))
    )
    part = fx.table(spark, folder, "part").select("p_partkey", raw.alias("header"))
    return extraction.canonicalize_headers(part, "header", fx.VOCAB).select("p_partkey", "field")


@query("normalize_entity", "SELECT c_custkey, replace(c_name, '#', '') || c_mktsegment || CASE WHEN c_acctbal < 0 THEN '省市' ELSE '' END AS name FROM customer")
def normalize_entity(spark: SparkSession, folder: str) -> DataFrame:
    tail = F.when(F.col("c_acctbal") < 0, "省市省").otherwise("市")
    raw = F.concat(F.replace("c_name", F.lit("#"), F.lit(" :")), F.lit("-"), "c_mktsegment", tail)
    return fx.table(spark, folder, "customer").select("c_custkey", text.normalize_entity(raw).alias("name"))


@query("clean_entity_column", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '济南市' WHEN 'MACHINERY' THEN '青岛高新区地'
  ELSE c_name END AS city_name, c_mktsegment AS segment FROM customer""")
def clean_entity_column(spark: SparkSession, folder: str) -> DataFrame:
    raw = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit(" 济南市凭借"), "c_name"))
        .when(F.col("c_mktsegment") == "MACHINERY", "青岛高新区地方市场").otherwise(F.col("c_name"))
    )
    df = fx.table(spark, folder, "customer").select("c_custkey", raw.alias("city_name"), F.col("c_mktsegment").alias("segment"))
    return transform.clean_entity(df)


def flag_unit(names: dict[str, str]) -> Column:
    return fx.case_of(F.col("l_returnflag"), names.items(), "")


@query("parse_number_unit", f"""SELECT {ITEM_SQL}, l_extendedprice AS value,
  CASE l_returnflag WHEN 'A' THEN '万亿元' WHEN 'N' THEN '元' END AS unit FROM lineitem""")
def parse_number_unit(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit("约 "), F.replace(F.format_number("l_extendedprice", 2), F.lit(","), F.lit("，")), F.lit(" "),
                   flag_unit({"A": "万亿元", "N": "元", "R": "吨"}))
    out = lineitem(spark, folder).withColumn("n", numbers.number_unit(raw))
    return out.select(*ITEM, "n.value", "n.unit")


CITY = Vocabulary(fields=(
    Field("GDP总量", "亿元", "city", ("GDP",)), Field("常住人口", "万人", "city", ("人口规模",)),
    Field("人均GDP", "元", "city"), Field("AQI", "", "city"), Field("城镇化率", "%", "city"),
))
CITY_FIELD = (("A", "GDP总量"), ("N", "常住人口"), ("R", "人均GDP"))


@query("to_canonical_unit", f"""SELECT {ITEM_SQL}, CASE l_returnflag WHEN 'A' THEN (CASE l_linestatus WHEN 'O' THEN l_extendedprice / 10000.0 ELSE l_extendedprice * 10000.0 END)
    WHEN 'N' THEN (CASE l_linestatus WHEN 'O' THEN l_extendedprice ELSE l_extendedprice / 10000.0 END) ELSE l_extendedprice END AS value,
  CASE l_returnflag WHEN 'A' THEN '亿元' WHEN 'N' THEN (CASE l_linestatus WHEN 'O' THEN '万元' ELSE '万人' END) ELSE (CASE l_linestatus WHEN 'O' THEN '吨' ELSE '元' END) END AS unit FROM lineitem""")
def to_canonical_unit(spark: SparkSession, folder: str) -> DataFrame:
    open_ = F.col("l_linestatus") == "O"
    unit = (
        F.when(F.col("l_returnflag") == "A", F.when(open_, "万元").otherwise("万亿元"))
        .when(F.col("l_returnflag") == "N", F.when(open_, "万元").otherwise("人")).otherwise(F.when(open_, "吨").otherwise("元"))
    )
    df = lineitem(spark, folder).select(
        *ITEM, fx.case_of(F.col("l_returnflag"), CITY_FIELD, "").alias("field"), F.col("l_extendedprice").alias("value"), unit.alias("unit"))
    return extraction.canonicalize(df, CITY, "field", "value", "unit").select(*ITEM, "value", "unit")


@query("unit_compatible", f"""WITH t AS (SELECT *, CASE l_returnflag WHEN 'A' THEN '亿元' WHEN 'N' THEN '万人' ELSE '元' END AS c,
  CASE WHEN l_quantity < 10 THEN '%' WHEN l_quantity < 20 THEN '万' WHEN l_quantity < 30 THEN '亿元' WHEN l_quantity < 40 THEN '元' END AS u FROM lineitem)
SELECT {ITEM_SQL}, CASE WHEN u IS NULL THEN true WHEN u = '%' THEN false WHEN c = '亿元' THEN u <> '万' WHEN c = '万人' THEN u = '万'
  ELSE u = '元' END AS ok FROM t""")
def unit_compatible(spark: SparkSession, folder: str) -> DataFrame:
    canon = fx.case_of(F.col("l_returnflag"), (("A", "亿元"), ("N", "万人")), "元")
    q = F.col("l_quantity")
    unit = F.when(q < 10, "%").when(q < 20, "万").when(q < 30, "亿元").when(q < 40, "元")
    return lineitem(spark, folder).select(*ITEM, numbers.unit_compatible(unit, canon).alias("ok"))


def price_sentence() -> Column:
    price = F.format_number("l_extendedprice", 2)
    return F.when(F.col("l_returnflag") == "A", F.concat(F.lit("全年GDP 总量达到 "), price, F.lit(" 亿元，增长 5%"))).when(
        F.col("l_returnflag") == "N", F.concat(F.lit("以 "), price, F.lit(" 万元的GDP 总量领先"))
    ).otherwise(F.concat(F.lit("GDP总量 "), price))


SQL_FIND_NUM = f"""SELECT {ITEM_SQL}, round(10000 * CASE l_returnflag WHEN 'N' THEN l_extendedprice * 10000.0 / 100000000.0 WHEN 'R' THEN l_extendedprice / 100000000.0 ELSE l_extendedprice END, 6) AS value FROM lineitem"""


@query("find_num", SQL_FIND_NUM)
def find_num(spark: SparkSession, folder: str) -> DataFrame:
    value = numbers.find_num(price_sentence(), "GDP ?总量", "亿元", ("万元",))
    return lineitem(spark, folder).select(*ITEM, F.round(value * 10000, 6).alias("value"))


@query("find_num_udf", SQL_FIND_NUM)
def find_num_udf(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    value = F.expr("find_num(sentence, 'GDP ?总量', '亿元', '万元')")
    return lineitem(spark, folder).withColumn("sentence", price_sentence()).select(*ITEM, F.round(value * 10000, 6).alias("value"))


@query("infer_year", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year FROM orders")
def infer_year(spark: SparkSession, folder: str) -> DataFrame:
    mark = F.when(F.col("o_orderstatus") == "P", "").otherwise("年")
    raw = F.concat(F.lit("第"), F.col("o_orderkey").cast("string"), F.lit("号 "), F.year("o_orderdate").cast("string"), mark, F.lit("1999年"))
    raw = F.when(F.col("o_orderstatus") == "P", F.regexp_replace(raw, "1999年$", "")).otherwise(raw)
    return dealt(fx.table(spark, folder, "orders")).select("o_orderkey", dates.infer_year(raw).alias("year"))


@query("parse_date", f"""SELECT {ITEM_SQL}, CASE l_returnflag WHEN 'N' THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date FROM lineitem""")
def parse_date(spark: SparkSession, folder: str) -> DataFrame:
    return lineitem(spark, folder).select(*ITEM, dates.parse_date(raw_date()).alias("date"))


@query("parse_date_range", """SELECT o_orderkey, strftime(least(o_orderdate, DATE '1998-02-03'), '%Y-%m-%d') AS lo,
  strftime(greatest(o_orderdate, DATE '1998-02-03'), '%Y-%m-%d') AS hi FROM orders""")
def parse_date_range(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit("from "), F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" or 1998-2-3 on"))
    return dealt(fx.table(spark, folder, "orders")).withColumn("r", dates.date_range(raw)).select("o_orderkey", "r.lo", "r.hi")


@query("parse_year_range", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN year(o_orderdate) - 2 WHEN o_orderstatus = 'F' THEN least(year(o_orderdate), 1998) END AS lo,
  CASE WHEN o_orderstatus = 'O' THEN year(o_orderdate) WHEN o_orderstatus = 'F' THEN greatest(year(o_orderdate), 1998) END AS hi FROM orders""")
def parse_year_range(spark: SparkSession, folder: str) -> DataFrame:
    y = F.year("o_orderdate")
    raw = F.when(F.col("o_orderstatus") == "O", F.concat((y - 2).cast("string"), F.lit(" 至"), y.cast("string"), F.lit("年"))).when(
        F.col("o_orderstatus") == "F", F.concat(F.lit("1998年 与 "), y.cast("string"), F.lit("年"))).otherwise("无")
    return dealt(fx.table(spark, folder, "orders")).withColumn("r", dates.year_range(raw)).select("o_orderkey", "r.lo", "r.hi")


@query("parse_entity_list", """SELECT o_orderkey, array_to_string(list_distinct_in_order, ',') AS entities FROM (
  SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN [replace(c_name, '#', ''), n_name] ELSE [n_name, replace(c_name, '#', '')] END AS list_distinct_in_order
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""")
def parse_entity_list(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: fx.table(spark, folder, n)
    j = dealt(t("orders")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.replace("c_name", F.lit("#"), F.lit(""))
    pair = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(name, F.lit("市、"), "n_name")).otherwise(
        F.concat("n_name", F.lit("区县，"), name))
    raw = F.concat(F.lit("请筛选： "), pair, F.lit("，"), name, F.lit("。其余不要"))
    return j.select("o_orderkey", F.array_join(dates.entity_list(raw), ",").alias("entities"))


EVENTS = ("click", "error", "purchase", "signup", "view")


@query("table_context_constraints", """SELECT event_id, event_type AS primary_entity, strftime(ts, '%Y-%m-%d') AS date,
  CASE WHEN value < 10 THEN strftime(ts, '%H') END AS hour FROM events""")
def table_context_constraints(spark: SparkSession, folder: str) -> DataFrame:
    stamp = F.when(F.col("value") < 10, F.concat(F.lit("监测时间："), F.date_format("ts", "yyyy-M-d HH:mm"))).otherwise(
        F.date_format("ts", "yyyy'年'M'月'd'日'"))
    raw = F.concat(F.lit("本表记录 "), "event_type", F.lit("市各监测点，"), stamp, F.lit("。结构与 view 一致"))
    return fx.table(spark, folder, "events").withColumn("c", dates.table_context(raw, EVENTS)).select(
        "event_id", "c.primary_entity", "c.date", "c.hour")


@query("format_value", f"""SELECT {ITEM_SQL}, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR)
  ELSE regexp_replace(printf('%.4f', v), '\\.?0+$', '') END AS shown FROM (SELECT *, l_extendedprice * l_discount AS v FROM lineitem)""")
def format_value(spark: SparkSession, folder: str) -> DataFrame:
    return lineitem(spark, folder).select(*ITEM, numbers.format_value(F.col("l_extendedprice") * F.col("l_discount")).alias("shown"))


@query("compress_text", """WITH t AS (SELECT o_orderkey, n_name, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS d, n_nationkey, o_orderstatus
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT o_orderkey, CASE WHEN n_nationkey >= 10 THEN n_name || '，total ' || o_totalprice || '，' || d
   ELSE n_name || '，priority 5，total ' || o_totalprice || '；' || d || '。none ' || o_orderstatus END AS dense
FROM t WHERE n_nationkey >= 10 OR o_orderstatus = 'F'""")
def compress_text(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: fx.table(spark, folder, n)
    j = dealt(t("orders")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.concat("n_name", F.lit("，priority 5，total "), F.col("o_totalprice").cast("string"), F.lit("；"),
                   F.col("o_orderdate").cast("date").cast("string"), F.lit("。none "), "o_orderstatus")
    dense = text.compress_text(raw, min_numbers=5, keep_keywords=["None F"])
    return j.select("o_orderkey", dense.alias("dense")).where("dense is not null")


STOPS = "', '".join(("template", "doc", "docx", "xlsx", "sheet", "table", "report", "form", "output", "upload"))


@query("extract_keywords", f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, '_-', '  '), '[A-Za-z0-9一-鿿]{{2,24}}') AS a FROM documents),
u AS (SELECT doc_id, i - 1 AS p, a[i] AS token FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM t)),
k AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id, lower(token) ORDER BY p) AS rn,
   count(*) OVER (PARTITION BY doc_id) AS n FROM u WHERE NOT regexp_full_match(token, '[0-9]+') AND lower(token) NOT IN ('{STOPS}'))
SELECT doc_id, token AS keyword FROM k WHERE rn = 1""")
def extract_keywords(spark: SparkSession, folder: str) -> DataFrame:
    docs = document_texts(spark, folder)
    return profiles.keyword_table(docs, "doc_id", "text").select("doc_id", "keyword")


@query("collapse_cjk_spaces", """SELECT p_partkey, '零件' || p_brand || '价格' || p_retailprice || '元 整 ' || p_name AS shown FROM part""")
def collapse_cjk_spaces(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit("零件 "), "p_brand", F.lit("  价格 "), F.col("p_retailprice").cast("string"), F.lit(" 元 整　"), "p_name")
    fixed = F.replace(text.collapse_cjk_spaces(raw), F.lit("整"), F.lit("整 "))
    return fx.table(spark, folder, "part").select("p_partkey", fixed.alias("shown"))


PAIRS = [("the", "THE"), ("e", "3"), (". ", ".\n"), ("zzzz", "-")]


@query("bulk_replace", """WITH a AS (SELECT doc_id, text AS t0, replace(text, 'the', 'THE') AS t1 FROM documents),
b AS (SELECT *, replace(t1, 'e', '3') AS t2 FROM a)
SELECT doc_id, replace(t2, '. ', '.' || chr(10)) AS text,
  CAST((length(t0) - length(replace(t0, 'the', ''))) / 3 + (length(t1) - length(replace(t1, 'e', ''))) + (length(t2) - length(replace(t2, '. ', ''))) / 2 AS BIGINT) AS changes FROM b""")
def bulk_replace(spark: SparkSession, folder: str) -> DataFrame:
    new, changes = text.replace_counted("text", PAIRS)
    return document_texts(spark, folder).select("doc_id", new.alias("text"), changes.alias("changes"))


@query("replace_first_only", """WITH a AS (SELECT doc_id, text AS t0, CASE WHEN contains(text, 'the') THEN substr(text, 1, strpos(text, 'the') - 1) || 'THE' || substr(text, strpos(text, 'the') + 3) ELSE text END AS t1 FROM documents)
SELECT doc_id, CASE WHEN contains(t1, '. ') THEN substr(t1, 1, strpos(t1, '. ') - 1) || '.' || chr(10) || substr(t1, strpos(t1, '. ') + 2) ELSE t1 END AS text,
  CAST(contains(t0, 'the') AS BIGINT) + CAST(contains(t1, '. ') AS BIGINT) AS changes FROM a""")
def replace_first_only(spark: SparkSession, folder: str) -> DataFrame:
    new, changes = text.replace_counted("text", [PAIRS[0], PAIRS[2]], first_only=True)
    return document_texts(spark, folder).select("doc_id", new.alias("text"), changes.alias("changes"))


WORDS = Vocabulary(names=("the", "und", "que", "los", "der", "pour", "con", "nicht", "tion", "with"))


@query("entity_mention_join", f"""WITH w AS (SELECT unnest({list(WORDS.names)}) AS entity, unnest(range(1, 11)) AS k)
SELECT doc_id, entity, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS ord FROM documents JOIN w ON contains(text, entity)""")
def entity_mention_join(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.find_mentions(document_texts(spark, folder), "doc_id", "text", WORDS)


@query("entity_mention_large_gazetteer", """WITH n AS (SELECT DISTINCT p_name FROM part),
t AS (SELECT l_orderkey || '-' || l_linenumber AS item, p_brand || ' of ' || p_name || ' and small ring' AS body FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT item, p_name AS entity FROM t JOIN n ON contains(body, p_name)""")
def entity_mention_large_gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """Part names in line-item texts, the names given as a table."""
    part = fx.table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    texts = lineitem(spark, folder).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item"),
        F.concat("p_brand", F.lit(" of "), "p_name", F.lit(" and small ring")).alias("body"))
    names = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return extraction.find_mentions_join(texts, "item", "body", names).select("item", "entity")


@query("entity_mention_dictionary", """WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS entity FROM benchmark)
SELECT doc_id, entity FROM documents JOIN n ON contains(text, entity)""")
def entity_mention_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Every longer word of the benchmark table in whole documents."""
    found = F.explode(F.regexp_extract_all("text", F.lit("([a-z]{5,})"), 1)).alias("name")
    names = fx.table(spark, folder, "benchmark").select(found).distinct().withColumn("ord", F.xxhash64("name"))
    return extraction.find_mentions_join(document_texts(spark, folder), "doc_id", "text", names).select("doc_id", "entity")


# --- sequences ---------------------------------------------------------------------------


SQL_LEVELS = range(1, 7)
SQL_SECTION_PATHS = f"""WITH l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 BETWEEN 1 AND 6 THEN o_orderkey % 9 END AS lv FROM orders),
h AS (SELECT *, {", ".join(f"max(CASE WHEN lv = {n} THEN o_orderkey END) OVER w AS h{n}" for n in SQL_LEVELS)} FROM l
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT o_orderkey, array_to_string(list_filter([{", ".join(
    "CASE WHEN " + " AND ".join([f"h{n} IS NOT NULL", *(f"h{n} > coalesce(h{up}, -1)" for up in range(1, n))]) + f" THEN CAST(h{n} AS VARCHAR) END"
    for n in SQL_LEVELS)}], lambda x: x IS NOT NULL), '/') AS path FROM h"""


@query("section_path_carry", SQL_SECTION_PATHS)
def section_path_carry(spark: SparkSession, folder: str) -> DataFrame:
    """Six heading levels."""
    place = F.col("o_orderkey") % 9
    level = F.when(place.between(1, 6), place)
    rows = dealt(fx.table(spark, folder, "orders")).select("o_custkey", "o_orderkey", level.alias("lv"), F.col("o_orderkey").cast("string").alias("t"))
    out = sequence.with_section_path(rows, "o_custkey", "o_orderkey", "lv", "t")
    return out.select("o_orderkey", F.array_join("section_path", "/").alias("path"))


@query("nearest_preceding_entity", f"""WITH s AS (SELECT o_orderkey, 'total ' || o_orderkey || ' by ' || replace(n_name, '_', '') || ' and ' || r_name || ', balance of ' || replace(n_name, '_', '') AS body
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT unnest({list(fx.VOCAB.names) + ['ASIA', 'EUROPE']}) AS name, unnest(range(1, {len(fx.VOCAB.names) + 3})) AS k),
p AS (SELECT o_orderkey, strpos(body, name) - 1 AS place, k, name FROM s JOIN w ON contains(body, name)),
a AS (SELECT o_orderkey, 0 AS anchor FROM s UNION ALL SELECT o_orderkey, strpos(body, 'balance') - 1 FROM s)
SELECT o_orderkey, anchor, coalesce((SELECT arg_max(name, (place, k)) FROM p WHERE p.o_orderkey = a.o_orderkey AND place <= anchor),
  (SELECT arg_min(name, (place, k)) FROM p WHERE p.o_orderkey = a.o_orderkey)) AS entity FROM a""")
def nearest_preceding_entity(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: fx.table(spark, folder, n)
    j = dealt(t("orders")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = F.replace("n_name", F.lit("_"), F.lit(""))
    body = F.concat(F.lit("total "), F.col("o_orderkey").cast("string"), F.lit(" by "), nation, F.lit(" and "), "r_name", F.lit(", balance of "), nation)
    vocab = Vocabulary(names=(*fx.VOCAB.names, "ASIA", "EUROPE"))
    texts = j.select("o_orderkey", body.alias("body")).select(
        "o_orderkey", extraction.entity_positions(F.col("body"), F.lit(None).cast("array<string>"), vocab).alias("positions"),
        F.array(F.lit(0), F.position(F.lit("balance"), "body") - 1).alias("anchors"))
    return sequence.nearest_entity_at(texts, "positions", "anchors").select("o_orderkey", "anchor", "entity")


@query("history_trim", """WITH m AS (SELECT o_custkey % 25 AS conv_id, o_orderkey AS turn, o_orderstatus AS role FROM orders WHERE o_custkey % 25 < 20
  UNION ALL SELECT o_custkey + 1000, o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 25 >= 20)
SELECT conv_id, turn, role FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM m) WHERE n <= 40 OR rn <= 30""")
def history_trim(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as messages: some conversations are long, most are short."""
    many = F.col("o_custkey") % 25
    messages = fx.table(spark, folder, "orders").select(
        F.when(many < 20, many).otherwise(F.col("o_custkey") + 1000).alias("conv_id"), F.col("o_orderkey").alias("turn"), F.col("o_orderstatus").alias("role"))
    return sequence.trim_history(messages)


@query("conversation_titles", """SELECT conv_id, substr(text, 1, 30) || CASE WHEN length(text) > 30 THEN '…' ELSE '' END AS title FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1""")
def conversation_titles(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.conversation_titles(fx.table(spark, folder, "conversations"))


@query("representative_sample", f"""{fx.DOC_BLOCKS}, r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY page_or_index) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks),
p AS (SELECT doc_id, 0 AS o, 'head' AS part, k, substr(text, 1, 500) AS sample FROM r WHERE k < 8
  UNION ALL SELECT doc_id, 1, 'middle', k, substr(text, 1, 500) FROM r WHERE n > 16 AND k >= n // 2 - 2 AND k < n // 2 + 2
  UNION ALL SELECT doc_id, 2, 'tail', k, substr(text, 1, 500) FROM r WHERE n > 20 AND k >= n - 4),
s AS (SELECT *, coalesce(sum(length(sample) + 20) OVER (PARTITION BY doc_id ORDER BY o, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM p)
SELECT doc_id, part, CAST(k AS INT) AS paragraph, sample FROM s WHERE spent < 6000""")
def representative_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.sample_paragraphs(materialised(fx.blocks(spark, folder), "blocks"))


@query("preview_assembly", f"""{fx.DOC_BLOCKS}, r AS (SELECT doc_id, substr(text, 1, 500) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY NOT contains(lower(text), 'the'), page_or_index, block_id) AS k FROM blocks)
SELECT doc_id, substr(string_agg(t, chr(10) ORDER BY k), 1, 10000) AS preview FROM r WHERE k <= 30 GROUP BY doc_id
UNION ALL SELECT 'part.xlsx', substr(string_agg(t, chr(10) ORDER BY p_partkey), 1, 10000) FROM (
  SELECT p_partkey, p_name || ' | ' || p_brand || ' | ' || p_size || ' | ' || p_retailprice AS t FROM part ORDER BY p_partkey LIMIT 200)""")
def preview_assembly(spark: SparkSession, folder: str) -> DataFrame:
    blocks = fx.blocks(spark, folder).drop("file_name").unionByName(part_blocks(spark, folder), allowMissingColumns=True)
    return sequence.assemble_preview(blocks, "THE")


SQL_CHUNKS = f"""WITH RECURSIVE sp AS (SELECT doc_id, string_split(text, '. ') AS a FROM documents),
pt AS (SELECT doc_id, i, {fx.sql_strip('a[i]')} AS t FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM sp)),
s AS (SELECT doc_id, t, length(t) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM pt WHERE t <> ''),
r AS (SELECT doc_id, k, t, n + 1 AS used, 1 AS c FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, s.t, CASE WHEN r.used + s.n > 3000 THEN s.n + 1 ELSE r.used + s.n + 1 END,
    CASE WHEN r.used + s.n > 3000 THEN r.c + 1 ELSE r.c END FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k + 1)
SELECT doc_id, c AS chunk_no, string_agg(t, chr(10) ORDER BY k) AS chunk FROM r GROUP BY doc_id, c"""


@query("chunk_blocks", SQL_CHUNKS)
def chunk_blocks(spark: SparkSession, folder: str) -> DataFrame:
    docs = document_texts(spark, folder)
    return sequence.chunk_documents(docs, "doc_id", F.split("text", "[.] "), 3000)


SQL_BLOCK_CHUNKS = f"""WITH RECURSIVE {fx.DOC_BLOCKS.removeprefix("WITH ")},
s AS (SELECT doc_id, t, length(t) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page_or_index) AS k
  FROM (SELECT doc_id, page_or_index, {fx.sql_strip('text')} AS t FROM blocks) WHERE t <> ''),
r AS (SELECT doc_id, k, t, n + 1 AS used, 1 AS c FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, s.t, CASE WHEN r.used + s.n > 3000 THEN s.n + 1 ELSE r.used + s.n + 1 END,
    CASE WHEN r.used + s.n > 3000 THEN r.c + 1 ELSE r.c END FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k + 1)
SELECT doc_id, c AS chunk_no, string_agg(t, chr(10) ORDER BY k) AS chunk FROM r GROUP BY doc_id, c"""


@query("chunk_block_table", SQL_BLOCK_CHUNKS)
def chunk_block_table(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.chunk_blocks(fx.blocks(spark, folder)).select("doc_id", "chunk_no", "chunk")


@query("block_udtf", f"{fx.DOC_BLOCKS} SELECT doc_id, page_or_index AS block_index, block_type, text, section FROM blocks")
def block_udtf(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    docs = fx.documents(spark, folder).select("doc_id", F.regexp_replace("text", "[.] ", ".\n\n1.2. Part ").alias("body"))
    docs.createOrReplaceTempView("factloom_docs")
    return spark.sql("""SELECT d.doc_id, b.block_index, b.block_type, b.text, coalesce(b.section, '') AS section
      FROM factloom_docs d, LATERAL text_blocks(d.body) b""")
