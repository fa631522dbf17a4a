"""The driver's tables seen as requests, documents, code and a dependency graph; each view with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dims
from ..operators import vectors
from .store import written

CLASSES = ["API_ROUTE", "PAGE_COMPONENT", "UI_COMPONENT", "UTILITY", "TYPE_DEFINITION", None]
CHANGES = ["ADDITION", "MODIFICATION", "DELETION"]
LANG_CHUNK = {"en": "FR", "de": "NFR", "fr": "Design"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(i, names):
    return F.array(*[F.lit(x) for x in names])[i.cast("int")]


def sql_pick(i: str, names: list) -> str:
    return "CASE " + i + " " + " ".join(f"WHEN {k} THEN " + ("NULL" if n is None else f"'{n}'") for k, n in enumerate(names)) + " END"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, chunk_type, source_file)"""
    chunk = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in LANG_CHUNK.items()], F.lit("General"))
    return table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", chunk.alias("chunk_type"), F.col("source").alias("source_file"))


def codes(spark: SparkSession, d: str) -> DataFrame:
    """(id, file_path, name, text, file_class)"""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return table(spark, d, "pages").select(F.concat(host, F.lit("::"), F.col("page_id").cast("string")).alias("id"), host.alias("file_path"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"), pick(F.col("page_id") % 6, CLASSES).alias("file_class"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """(cr, text, change_type, primary)"""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("cr"), "text", pick(F.col("item_id") % 3, CHANGES).alias("change_type"), pick(F.col("item_id") % 4, list(dims.CHUNKS)).alias("primary"))


def code_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("code_id"), "embedding", pick(F.col("label") % 6, CLASSES).alias("file_class"))


def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("doc_id"), "embedding", pick(F.col("label") % 4, list(dims.CHUNKS)).alias("chunk_type"))


FLOOR = 0.2


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """(code_id, doc_id, score): cosine times layer compatibility (1 at most) of pairs of different vectors, of those that are among the five best of either side; kept, as several steps read it"""
    number = lambda c: F.substring(c, 2, 20).alias("number")
    c, x = code_vectors(spark, d).select("*", number("code_id")), doc_vectors(spark, d).select("*", number("doc_id"))
    return written(vectors.dual_nearest(c, x, 5, FLOOR, ("code_id", "embedding", "file_class"), ("doc_id", "embedding", "chunk_type"), dims.compat(), keys=("number", "number")))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, node_type, file_path, file_class)"""
    t = lambda n: table(spark, d, n)
    key = lambda p, c: F.concat(F.lit(p + "::"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    r = t("region").select(key("r", "r_regionkey").alias("node_id"), F.lit("File").alias("node_type"), key("r", "r_regionkey").alias("file_path"), none.alias("file_class"))
    n = t("nation").select(key("n", "n_nationkey"), F.lit("Class"), key("r", "n_regionkey"), F.lit("UTILITY"))
    c = t("customer").select(key("c", "c_custkey"), F.lit("Function"), key("n", "c_nationkey"), F.when(F.col("c_mktsegment") == "BUILDING", "UTILITY").otherwise("UI_COMPONENT"))
    s = t("supplier").select(key("s", "s_suppkey"), F.lit("Interface"), key("n", "s_nationkey"), F.lit("TYPE_DEFINITION"))
    o = t("orders").select(key("o", "o_orderkey"), F.lit("Method"), key("c", "o_custkey"), F.lit("API_ROUTE"))
    p = t("part").select(key("p", "p_partkey"), F.lit("InterfaceField"), none, none)
    return r.union(n).union(c).union(s).union(o).union(p)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, target_id, edge_type)"""
    t = lambda n: table(spark, d, n)
    key = lambda p, c: F.concat(F.lit(p + "::"), F.col(c).cast("string"))
    e = lambda n, a, b, k: t(n).select(key(*a).alias("source_id"), key(*b).alias("target_id"), F.lit(k).alias("edge_type"))
    line = lambda a, b, k: t("lineitem").select(a[1], b[1]).distinct().select(key(*a).alias("source_id"), key(*b).alias("target_id"), F.lit(k).alias("edge_type"))
    out = e("nation", ("r", "n_regionkey"), ("n", "n_nationkey"), "CONTAINS")
    for x in (
        e("customer", ("n", "c_nationkey"), ("c", "c_custkey"), "CONTAINS"), e("supplier", ("n", "s_nationkey"), ("s", "s_suppkey"), "CONTAINS"), e("orders", ("o", "o_orderkey"), ("c", "o_custkey"), "CALLS"),
        e("orders", ("c", "o_custkey"), ("o", "o_orderkey"), "DEFINES_METHOD"), line(("o", "l_orderkey"), ("p", "l_partkey"), "TYPED_BY"), line(("p", "l_partkey"), ("s", "l_suppkey"), "FIELDS_ACCESSED"), e("supplier", ("s", "s_suppkey"), ("n", "s_nationkey"), "IMPORTS"),
    ):
        out = out.union(x)
    return out


_STOP = ", ".join(f"'{w}'" for w in dims.STOP)


def sql_tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({_STOP}))"


SQL_DOCS = "docs AS (SELECT 'd' || doc_id AS id, text, CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANG_CHUNK.items()) + " ELSE 'General' END AS chunk_type, source AS source_file FROM documents)"
SQL_CODES = rf"codes AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) || '::' || page_id AS id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS file_path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text, {sql_pick('page_id % 6', CLASSES)} AS file_class FROM pages)"
SQL_REQ = f"req AS (SELECT item_id AS cr, text, {sql_pick('item_id % 3', CHANGES)} AS change_type, {sql_pick('item_id % 4', list(dims.CHUNKS))} AS prim FROM benchmark)"
_COMPAT = dims.values([(c, t, f) for c, row in dims.COMPAT.items() for t, f in zip(dims.CHUNKS, row)], "compat", "file_class, chunk_type, compat")
_E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
SQL_UNIT = f"unit AS (SELECT vec_id, label, list_transform({_E}, lambda x: x / sqrt(list_inner_product({_E}, {_E}))) AS v FROM embeddings)"
SQL_SIM = f"""{SQL_UNIT}, sim AS (SELECT code_id, doc_id, round(s * compat, 6) AS score FROM (
  SELECT 'c' || a.vec_id AS code_id, 'd' || b.vec_id AS doc_id, coalesce({sql_pick('(a.label % 6)', CLASSES)}, 'None') AS file_class, {sql_pick('(b.label % 4)', list(dims.CHUNKS))} AS chunk_type, list_inner_product(a.v, b.v) AS s
  FROM unit a JOIN unit b ON a.vec_id <> b.vec_id) p JOIN {_COMPAT} USING (file_class, chunk_type))"""
SQL_MATRIX = f"""{SQL_SIM}, matrix AS (SELECT code_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY code_id ORDER BY score DESC, doc_id) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code_id) AS d FROM sim) WHERE (c <= 5 OR d <= 5) AND score >= {FLOOR})"""
SQL_NODES = """nodes AS (SELECT 'r::' || r_regionkey AS node_id, 'File' AS node_type, 'r::' || r_regionkey AS file_path, NULL AS file_class FROM region
 UNION ALL SELECT 'n::' || n_nationkey, 'Class', 'r::' || n_regionkey, 'UTILITY' FROM nation
 UNION ALL SELECT 'c::' || c_custkey, 'Function', 'n::' || c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'UTILITY' ELSE 'UI_COMPONENT' END FROM customer
 UNION ALL SELECT 's::' || s_suppkey, 'Interface', 'n::' || s_nationkey, 'TYPE_DEFINITION' FROM supplier
 UNION ALL SELECT 'o::' || o_orderkey, 'Method', 'c::' || o_custkey, 'API_ROUTE' FROM orders
 UNION ALL SELECT 'p::' || p_partkey, 'InterfaceField', NULL, NULL FROM part)"""
SQL_EDGES = """edges AS (SELECT 'r::' || n_regionkey AS source_id, 'n::' || n_nationkey AS target_id, 'CONTAINS' AS edge_type FROM nation
 UNION ALL SELECT 'n::' || c_nationkey, 'c::' || c_custkey, 'CONTAINS' FROM customer
 UNION ALL SELECT 'n::' || s_nationkey, 's::' || s_suppkey, 'CONTAINS' FROM supplier
 UNION ALL SELECT 'o::' || o_orderkey, 'c::' || o_custkey, 'CALLS' FROM orders
 UNION ALL SELECT 'c::' || o_custkey, 'o::' || o_orderkey, 'DEFINES_METHOD' FROM orders
 UNION ALL SELECT DISTINCT 'o::' || l_orderkey, 'p::' || l_partkey, 'TYPED_BY' FROM lineitem
 UNION ALL SELECT DISTINCT 'p::' || l_partkey, 's::' || l_suppkey, 'FIELDS_ACCESSED' FROM lineitem
 UNION ALL SELECT 's::' || s_suppkey, 'n::' || s_nationkey, 'IMPORTS' FROM supplier)"""
_CONFIG = dims.values(dims.edge_rows(), "config", "edge_type, ord, direction, max_depth, severity, weight")
SQL_CONFIG = f"config AS (SELECT * FROM {_CONFIG})"


def sql_bm25(name: str, base: str) -> str:
    """CTEs that end in name(cr, id, score) over the requests and the CTE base(id, text)."""
    return f"""
{name}_t AS MATERIALIZED (SELECT id, {sql_tokens('text')} AS ts FROM {base}), {name}_l AS (SELECT id, len(ts) AS dl FROM {name}_t),
{name}_s AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM {name}_l),
{name}_p AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM {name}_t) GROUP BY id, term),
{name}_r AS (SELECT term, df, ln(n - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS raw FROM (SELECT term, count(*) AS df FROM {name}_p GROUP BY term), {name}_s),
{name}_i AS (SELECT term, df, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(raw) FROM {name}_r) ELSE raw END AS idf FROM {name}_r),
{name}_q AS (SELECT cr, term, count(*) AS qtf FROM (SELECT cr, unnest({sql_tokens('text')}) AS term FROM req) GROUP BY cr, term),
{name} AS MATERIALIZED (SELECT cr, id, round(sum(qtf * idf * (tf * CAST(2.5 AS DOUBLE)) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN {name}_i USING (term) JOIN {name}_p USING (term) JOIN {name}_l USING (id), {name}_s GROUP BY cr, id)"""
