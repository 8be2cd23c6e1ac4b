"""Queries: documents for templates, name similarity, vectors, column mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import matching, profiles, vectors
from factloom.operators.matching import TemplateProfile
from factloom.operators.similarity import similar_names
from factloom.plans import fixtures as fx
from factloom.plans.registry import query
from factloom.plans.scans import part_blocks
from factloom.session import materialised

PROFILES = (
    TemplateProfile("english src1 report.xlsx", ("en", "src1"), (), ("src1", "the", "with")),
    TemplateProfile("german words.docx", ("de",), ("nicht", "und"), ("und", "der")),
    TemplateProfile("keywords only.xlsx", (), (), ("que", "pour", "src7", "tion", "leau")),
    TemplateProfile("nothing.xlsx", (), (), ("zzzzz",)),
)
NAMES = [p.name for p in PROFILES]


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """Cards whose preview is the whole text."""
    return fx.documents(spark, folder).select("doc_id", "file_name", F.col("text").alias("text_preview"))


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """Fields = language and source; entities = the distinct words of the whole text."""
    docs = fx.documents(spark, folder)
    f = docs.select("doc_id", F.lit("field").alias("kind"), F.explode(F.array("lang", "source")).alias("term"))
    e = docs.select("doc_id", F.lit("entity").alias("kind"),
                    F.explode(F.array_distinct(F.split("text", "[^\\p{L}]+"))).alias("term"))
    return f.unionByName(e.where("term <> ''"))


def lits(values) -> str:
    return "CAST([" + ", ".join(f"'{v}'" for v in values) + "] AS VARCHAR[])"


SQL_TEMPLATES = "t AS (" + " UNION ALL ".join(
    f"SELECT '{p.name}' AS template, {lits(p.fields)} AS f, {lits(p.entities)} AS e, {lits(p.keywords)} AS k" for p in PROFILES
) + ")"
SQL_SCORED = f"""WITH {fx.SQL_DOCUMENTS}, {SQL_TEMPLATES},
d AS (SELECT doc_id, file_name, [lang, source] AS df, list_distinct(regexp_split_to_array(text, '[^\\p{{L}}]+')) AS de,
   lower(file_name) || chr(10) || lower(text) AS body FROM docs),
h AS (SELECT template, doc_id, file_name, len(f) AS nf, list_sort(list_intersect(f, df)) AS fh, list_sort(list_intersect(e, de)) AS eh,
   list_sort(list_filter(k, lambda w: contains(body, lower(w)))) AS kh FROM d, t),
scored AS (SELECT *, CAST(3.0 * len(fh) + 4.0 * len(eh) + least(2.0, 0.5 * len(kh)) AS DOUBLE) AS score FROM h WHERE len(fh) + len(eh) + len(kh) > 0),
best AS (SELECT template, bool_or(len(eh) > 0) AS ae, bool_or(len(fh) > 0 AND nf > 0) AS af, max(score) AS top FROM scored GROUP BY template),
moded AS (SELECT s.*, top, greatest(top * 0.5, 1.0) AS cut, CASE WHEN ae THEN 'entity' WHEN af THEN 'field' WHEN top >= greatest(top * 0.5, 1.0) THEN 'score' ELSE 'fallback_all' END AS mode
   FROM scored s JOIN best USING (template)),
matched AS (SELECT template, doc_id, score, mode, fh, eh, kh FROM moded WHERE CASE mode WHEN 'entity' THEN len(eh) > 0 WHEN 'field' THEN len(fh) > 0 WHEN 'score' THEN score >= cut ELSE false END
   UNION ALL SELECT template, NULL, NULL, 'fallback_all', NULL, NULL, NULL FROM t WHERE template NOT IN (SELECT template FROM moded WHERE mode <> 'fallback_all'))"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return matching.score_documents(cards(spark, folder), terms(spark, folder), PROFILES)


def joined(c: str) -> F:
    return F.array_join(c, ",").alias(c)


@query("document_match_rules", f"""{SQL_SCORED} SELECT template, doc_id, score, mode, array_to_string(fh, ',') AS field_hits,
  array_to_string(eh, ',') AS entity_hits, array_to_string(kh, ',') AS keyword_hits FROM matched""")
def document_match_rules(spark: SparkSession, folder: str) -> DataFrame:
    m = matching.match_by_rules(materialised(scored(spark, folder), "scored"), PROFILES)
    return m.select("template", "doc_id", "score", "mode", joined("field_hits"), joined("entity_hits"), joined("keyword_hits"))


@query("suggest_documents", f"""{SQL_SCORED} SELECT template, doc_id, round(score / CASE WHEN top = 0 THEN 1 ELSE top END, 4) AS score,
  (len(fh) > 0 OR len(eh) > 0) AND mode <> 'fallback_all' AS recommended FROM moded""")
def suggest_documents(spark: SparkSession, folder: str) -> DataFrame:
    s = materialised(scored(spark, folder), "scored")
    return matching.suggest(s, matching.match_by_rules(s, PROFILES)).select("template", "doc_id", "score", "recommended")


SQL_NAME_HITS = """named AS (SELECT 'english src1 report.xlsx' AS template, doc_id FROM docs WHERE contains(lower(file_name), 'english') OR contains(lower(file_name), 'src1') OR contains(lower(file_name), 'report')
  UNION ALL SELECT 'german words.docx', doc_id FROM docs WHERE contains(lower(file_name), 'german') OR contains(lower(file_name), 'words')
  UNION ALL SELECT 'keywords only.xlsx', doc_id FROM docs WHERE contains(lower(file_name), 'keywords') OR contains(lower(file_name), 'only')
  UNION ALL SELECT 'nothing.xlsx', doc_id FROM docs WHERE contains(lower(file_name), 'nothing'))"""


@query("document_match_filename", f"WITH {fx.SQL_DOCUMENTS}, {SQL_NAME_HITS} SELECT template, doc_id FROM named")
def document_match_filename(spark: SparkSession, folder: str) -> DataFrame:
    return matching.match_by_name(fx.documents(spark, folder), NAMES).select("template", "doc_id")


@query("trigram_similarity_join", """WITH n AS (SELECT p_partkey, lower(p_name || '_' || p_brand) AS low, replace(lower(p_name), ' ', '') || lower(p_brand) AS s FROM part),
t AS (SELECT DISTINCT p_name || ' ' || p_type || '.xlsx' AS template, replace(lower(p_name), ' ', '') || lower(p_type) AS ts, string_split(lower(p_name || ' ' || p_type), ' ') AS toks FROM part),
a AS (SELECT p_partkey, low, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS a FROM n),
b AS (SELECT template, toks, list_distinct(list_transform(range(1, length(ts) - 1), lambda i: substr(ts, i, 3))) AS b FROM t),
g AS (SELECT p_partkey, template, len(list_intersect(a, b)) AS i, len(a) + len(b) AS n, len(list_filter(toks, lambda w: contains(low, w))) AS hits FROM a, b)
SELECT p_partkey, template, hits, round(i / (n - i) * 0.7 + least(1.0, hits / 3.0) * 0.3, 9) AS similarity FROM g WHERE i / (n - i) * 0.7 + least(1.0, hits / 3.0) * 0.3 >= 0.5 - 1e-9""")
def trigram_similarity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Part names against the report names of all kinds of parts."""
    part = fx.table(spark, folder, "part")
    names = part.select("p_partkey", F.concat_ws("_", "p_name", "p_brand").alias("file_name"))
    reports = part.select(F.concat(F.concat_ws(" ", "p_name", "p_type"), F.lit(".xlsx")).alias("template")).distinct().withColumn("name", F.col("template"))
    out = similar_names(names, "p_partkey", "file_name", reports, "template", "name", 0.5)
    return out.select("p_partkey", "template", "hits", F.round("similarity", 9).alias("similarity"))


@query("trigram_similarity_named", """WITH n AS (SELECT p_partkey, p_name || '_' || p_brand AS file_name, replace(lower(p_name), ' ', '') || lower(p_brand) AS s FROM part),
t AS (SELECT unnest(['small ring report.xlsx', 'Brand#2 blue-bolt.docx']) AS template, unnest(['smallringreport', 'brand#2bluebolt']) AS ts,
   unnest([['small', 'ring', 'report'], ['brand#', 'blue', 'bolt']]) AS toks),
g AS (SELECT p_partkey, template, file_name, toks, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS a,
   list_distinct(list_transform(range(1, length(ts) - 1), lambda i: substr(ts, i, 3))) AS b FROM n, t)
SELECT p_partkey, template, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) * 0.7
  + least(1.0, len(list_filter(toks, lambda w: contains(lower(file_name), w))) / 3.0) * 0.3, 9) AS similarity FROM g
  WHERE len(list_intersect(a, b)) > 0 OR len(list_filter(toks, lambda w: contains(lower(file_name), w))) > 0""")
def trigram_similarity_named(spark: SparkSession, folder: str) -> DataFrame:
    names = fx.table(spark, folder, "part").select("p_partkey", F.concat_ws("_", "p_name", "p_brand").alias("file_name"))
    asked = spark.createDataFrame([("small ring report.xlsx",), ("Brand#2 blue-bolt.docx",)], "template string").withColumn("name", F.col("template"))
    out = similar_names(names, "p_partkey", "file_name", asked, "template", "name")
    return out.select("p_partkey", "template", F.round("similarity", 9).alias("similarity"))


# --- vectors: queries are the label centroids, documents the labels ---------------------------

SQL_QUERY_VECTORS = """pos AS (SELECT label, vec_id, i, embedding[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
cen AS (SELECT label, i, avg(x) AS x FROM pos GROUP BY label, i),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM cen GROUP BY label)"""
SQL_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)"


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    flat = fx.table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


@query("vector_topk", f"""WITH {SQL_QUERY_VECTORS}, s AS (SELECT query_id, vec_id, {SQL_COSINE} AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.1)
SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    out = matching.vector_topk(fx.table(spark, folder, "embeddings"), query_vectors(spark, folder), 10, 0.1, block_id="vec_id")
    return out.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("vector_topk_indexed", f"""WITH {SQL_QUERY_VECTORS}, s AS (SELECT query_id, vec_id, {SQL_COSINE} AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def vector_topk_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same search without a least score, over an index that clusters too far off are skipped in."""
    index = vectors.build_index(fx.table(spark, folder, "embeddings"), "vec_id", "embedding")
    out = vectors.search(index, query_vectors(spark, folder), 10)
    return out.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


# Matching wants near vectors: here the queries are vectors of the table itself, the first one of each label.
SQL_FIRST_VECTORS = "q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)"


def first_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return fx.table(spark, folder, "embeddings").groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))


@query("document_match_vector", f"""WITH {SQL_FIRST_VECTORS}, s AS (SELECT query_id, label, vec_id, {SQL_COSINE.replace(", v)", ", CAST(v AS DOUBLE[]))")} AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS k FROM s WHERE score >= 0.35),
d AS (SELECT query_id, label, avg(score) AS a FROM r WHERE k <= 5 GROUP BY query_id, label),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, label) AS k FROM d)
SELECT query_id, label, round(a, 6) AS avg_score FROM b WHERE k <= 5 AND a >= 0.45""")
def document_match_vector(spark: SparkSession, folder: str) -> DataFrame:
    out = matching.match_by_vector(fx.table(spark, folder, "embeddings"), first_vectors(spark, folder), "label", "vec_id")
    return out.select("query_id", "label", F.round("avg_score", 6).alias("avg_score"))


# The label whose first vector stands for a template.
TEMPLATE_LABELS = (("english src1 report.xlsx", 1), ("keywords only.xlsx", 3))
SQL_TEMPLATE_LABELS = "(VALUES " + ", ".join(f"('{t}', {n})" for t, n in TEMPLATE_LABELS) + ") AS tl(template, label)"


@query("document_match_cascade", f"""{SQL_SCORED}, {SQL_NAME_HITS}, {SQL_FIRST_VECTORS},
vs AS (SELECT tl.template, CAST(e.vec_id AS VARCHAR) AS doc_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS score
  FROM {SQL_TEMPLATE_LABELS} JOIN q ON q.query_id = tl.label, embeddings e WHERE CAST(e.vec_id AS VARCHAR) IN (SELECT doc_id FROM docs)),
vn AS (SELECT * FROM vs WHERE score >= 0.45 AND (template NOT IN (SELECT template FROM named) OR (template, doc_id) IN (SELECT template, doc_id FROM named))),
vec AS (SELECT template, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY score DESC, doc_id) AS k FROM vn) WHERE k <= 5),
allt AS (SELECT template, doc_id, 1 AS tier, CASE WHEN template IN (SELECT template FROM named) THEN 'filename+vector' ELSE 'vector' END AS mode FROM vec
  UNION ALL SELECT template, doc_id, 2, 'filename' FROM named
  UNION ALL SELECT template, doc_id, 3, CASE WHEN mode = 'fallback_all' THEN mode ELSE 'rules' END FROM matched)
SELECT a.template, doc_id, mode FROM allt a WHERE tier = (SELECT min(tier) FROM allt b WHERE b.template = a.template)""")
def document_match_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Vector search on the name hits where a template has any, on all documents else; then names, then rules."""
    docs = fx.documents(spark, folder)
    by_name = materialised(matching.match_by_name(docs, NAMES), "named")
    queries = first_vectors(spark, folder).join(
        F.broadcast(spark.createDataFrame(TEMPLATE_LABELS, "template string, label int")), F.col("query_id") == F.col("label")).select(
        F.col("template").alias("query_id"), "vector")
    vectors = fx.table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "vec_id", "embedding").join(
        docs.select("doc_id"), "doc_id", "left_semi")
    by_vector = matching.match_narrowed_by_vector(vectors, queries, by_name, "doc_id", "vec_id").withColumnRenamed("query_id", "template")
    rules = matching.match_by_rules(materialised(scored(spark, folder), "scored"), PROFILES)
    out = matching.match_cascade(docs, NAMES, by_name, materialised(by_vector, "by-vector"), materialised(rules, "rules"))
    return out.select("template", "doc_id", "mode")


SOURCE_HEADERS = ("Part", "Brand", "Size", "Retail Price (USD)", "Region", "Date")


@query("template_source_overlap", """WITH f AS (SELECT DISTINCT l_returnflag || l_linestatus AS template, 'Brand#' || (l_suppkey % 40) AS field FROM lineitem WHERE l_quantity > 45),
h AS (SELECT p_brand AS field FROM part UNION SELECT p_name FROM part),
d AS (SELECT avg(CASE WHEN p_type <> 'PROMO' THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT DISTINCT p_type FROM part))
SELECT template, count(*) AS n_fields, count(h.field) AS n_overlap, round(count(h.field) / count(*), 4) AS overlap, round(any_value(share), 4) AS sheet_share, true AS all_structured,
  count(h.field) / count(*) >= 0.3 AND any_value(share) >= 0.5 AS applicable FROM f LEFT JOIN h ON f.field = h.field, d GROUP BY template""")
def template_source_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """One document per type of part, whose headers are the brands and names of its parts; templates ask for the brands that line items name."""
    fields = fx.table(spark, folder, "lineitem").where("l_quantity > 45").select(
        F.concat("l_returnflag", "l_linestatus").alias("template"),
        F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 40).cast("string")).alias("field")).distinct()
    headers = F.array("p_brand", "p_name")
    blocks = fx.table(spark, folder, "part").select(F.col("p_type").alias("doc_id"), headers.alias("headers"), headers.alias("cells"))
    kind = F.when(F.col("doc_id") == "PROMO", "docx").otherwise("xlsx")
    docs = blocks.select("doc_id").distinct().withColumn("doc_type", kind)
    return matching.direct_fill_applicable(fields, blocks, docs)


def source_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of a source whose rows are parts, with two more columns at the end."""
    seen = materialised(profiles.distinct_headers(part_blocks(spark, folder), F.col("page_or_index")).select(
        "header", F.col("first_pos.c").alias("pos")), "headers")
    n = seen.agg(F.max("pos").alias("n"))
    return seen.unionByName(n.select(F.explode(F.array(
        F.struct(F.lit("Region ").alias("header"), (F.col("n") + 1).alias("pos")),
        F.struct(F.lit("Date").alias("header"), (F.col("n") + 2).alias("pos")))).alias("s")).select("s.header", "s.pos"))


@query("column_mapping", """SELECT 't' AS template, lower(n_name) AS header, n_name || ' ' AS source_column FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT * FROM (VALUES ('t', 'part', 'Part'), ('t', ' SIZE', 'Size'), ('t', 'Retailprice', 'Retail Price (USD)')) v(template, header, source_column)
WHERE (SELECT count(*) FROM part) > 0""")
def column_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of the part rows and one per nation; the template asks for every second nation."""
    nation = fx.table(spark, folder, "nation")
    wanted = spark.createDataFrame([("t", h) for h in ("part", " SIZE", "Retailprice", "Weight")], "template string, header string").unionByName(
        nation.where("n_nationkey % 2 = 0").select(F.lit("t").alias("template"), F.lower("n_name").alias("header")))
    there = source_headers(spark, folder).unionByName(
        nation.select(F.concat("n_name", F.lit(" ")).alias("header"), (F.col("n_nationkey") + 100).cast("int").alias("pos")))
    return matching.map_columns(wanted, there, fx.VOCAB.header_table(spark))


@query("column_guess", """SELECT * FROM (VALUES ('entity', 'Region '), ('time', 'Date')) v(role, source_column) WHERE (SELECT count(*) FROM part) > 0""")
def column_guess(spark: SparkSession, folder: str) -> DataFrame:
    return matching.guess_columns(source_headers(spark, folder), entity=("city", "region"))
