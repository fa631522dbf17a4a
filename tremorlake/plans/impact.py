"""Queries of the dependency graph, verdicts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import dims
from ..functions.text import scope, token_estimate
from ..operators import audit as A, graph as G, reports as P, rescoring as R, verdicts as V
from . import fixtures as fx
from .registry import query
from .store import written

GRAPH = f"WITH {fx.SQL_NODES}, {fx.SQL_EDGES}, {fx.SQL_CONFIG}"
DEG = "deg AS (SELECT node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(1 - i) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT source_id AS node_id, 0 AS i FROM edges UNION ALL SELECT target_id, 1 FROM edges) GROUP BY node_id)"
_FAN = dims.values(list(dims.FAN_IN.items()), "fan", "node_type, cap")


def sql_bfs(hub: int) -> str:
    """CTEs from seeds(node_id, ord, low) to cis; the levels are unrolled."""
    out = f"""{DEG}, info AS (SELECT node_id, coalesce(degree, 0) AS degree, node_type = 'ExternalPackage' AS never, cap > 0 AND coalesce(in_degree, 0) > cap AS crowded, coalesce(file_class = 'UTILITY', false) AS utility FROM nodes LEFT JOIN deg USING (node_id) LEFT JOIN {_FAN} USING (node_type)),
step AS MATERIALIZED (SELECT DISTINCT u, nbr, edge_type, s.ord, max_depth, i.degree > {hub} AS hub FROM (SELECT CASE WHEN direction = 'forward' THEN source_id ELSE target_id END AS u, CASE WHEN direction = 'forward' THEN target_id ELSE source_id END AS nbr, edge_type, ord, max_depth FROM edges JOIN config USING (edge_type)) s
  JOIN info i ON i.node_id = u JOIN info j ON j.node_id = nbr WHERE NOT j.never AND NOT coalesce(j.crowded, false) AND nbr NOT IN (SELECT node_id FROM seeds)),
l0 AS (SELECT node_id, 0 AS depth, '' AS chain, '' AS edge, node_id AS path, node_id AS seed, low, utility, [lpad(CAST(ord AS VARCHAR), 12, '0')] AS seq, -1 AS rank FROM seeds JOIN info USING (node_id))"""
    seen = "SELECT node_id, rank FROM l0"
    for d in range(3):
        out += f""", a{d + 1} AS (SELECT nbr AS node_id, {d + 1} AS depth, chain || CASE WHEN chain = '' THEN '' ELSE '>' END || edge_type AS chain, edge_type AS edge, path || '>' || nbr AS path, seed, low, utility, list_concat(seq, [lpad(CAST(s.ord AS VARCHAR), 3, '0'), nbr]) AS seq,
  CASE c.severity WHEN 'Tinggi' THEN 0 WHEN 'Menengah' THEN 1 ELSE 2 END AS rank FROM l{d} JOIN step s ON u = node_id JOIN config c USING (edge_type)
  WHERE {d} < CASE WHEN hub OR (edge_type = 'CALLS' AND (low OR utility)) THEN 1 ELSE s.max_depth END),
l{d + 1} AS MATERIALIZED (SELECT node_id, depth, chain, edge, path, seed, low, utility, seq, rank FROM (SELECT a.*, coalesce(had, 9) AS had, coalesce(min(a.rank) OVER (PARTITION BY a.node_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS run FROM a{d + 1} a LEFT JOIN (SELECT node_id, min(rank) AS had FROM ({seen}) GROUP BY node_id) b ON b.node_id = a.node_id) WHERE rank < had AND rank < run)"""
        seen += f" UNION ALL SELECT node_id, rank FROM l{d + 1}"
    cols = "node_id, depth, chain, edge, path, seed, rank"
    out += f", cis AS (SELECT node_id, depth, chain, edge, path, seed, depth = 0 AS is_seed, CASE WHEN edge = '' THEN 'Tinggi' ELSE (SELECT severity FROM config WHERE edge_type = edge) END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY rank) AS rn FROM ({' UNION ALL '.join(f'SELECT {cols} FROM l{i}' for i in range(4))})) WHERE rn = 1)"
    return out


SEEDS = "seeds AS (SELECT 's::' || s_suppkey AS node_id, s_suppkey AS ord, s_suppkey % 2 = 0 AS low FROM supplier UNION ALL SELECT 'c::' || c_custkey, c_custkey + 1000000, c_acctbal < 0 FROM customer)"


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers, then all customers"""
    s = fx.table(spark, d, "supplier").select(F.concat(F.lit("s::"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 2 == 0).alias("low"))
    return s.union(fx.table(spark, d, "customer").select(F.concat(F.lit("c::"), F.col("c_custkey").cast("string")), F.col("c_custkey") + 1000000, F.col("c_acctbal") < 0))


def impact_set(spark: SparkSession, d: str, hub: int) -> DataFrame:
    return G.propagate(fx.nodes(spark, d), fx.edges(spark, d), seeds(spark, d), dims.edge_config(spark), hub, written=written)


def _flat(cis: DataFrame) -> DataFrame:
    return cis.select("node_id", "depth", F.array_join("chain", ">").alias("chain"), F.array_join("path", ">").alias("path"), "seed", "severity", "is_seed")


@query(f"{GRAPH}, {DEG} SELECT node_id, in_degree, out_degree, degree FROM deg WHERE degree > 20")
def degree_hubs(spark: SparkSession, d: str) -> DataFrame:
    return G.hubs(fx.edges(spark, d))


@query("SELECT s_nationkey AS cr, 's::' || s_suppkey AS node_id, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, 's::' || s_suppkey) <= 5 THEN 'high' ELSE 'low' END AS tier FROM supplier")
def conf_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "supplier").select(F.col("s_nationkey").alias("cr"), F.concat(F.lit("s::"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_acctbal").alias("score"))
    return G.confidence_tiers(s).select("cr", "node_id", "tier")


_CIS = "SELECT node_id, depth, chain, path, seed, severity, is_seed FROM cis"


@query(f"{GRAPH}, {SEEDS}, {sql_bfs(20)} {_CIS}")
def bfs_capped(spark: SparkSession, d: str) -> DataFrame:
    return _flat(impact_set(spark, d, 20))


@query(f"{GRAPH}, {SEEDS}, {sql_bfs(1000000)} {_CIS}")
def bfs_severity(spark: SparkSession, d: str) -> DataFrame:
    """Without hubs, so that whole chains are followed"""
    return _flat(impact_set(spark, d, 1000000))


_TREE = """edges AS (SELECT 'r::' || n_regionkey AS source_id, 'n::' || n_nationkey AS target_id, 'CONTAINS' AS edge_type FROM nation UNION ALL SELECT 'c::' || o_custkey, 'o::' || o_orderkey, 'CONTAINS' FROM orders UNION ALL SELECT 'o::' || o_orderkey, 'c::' || o_custkey, 'CALLS' FROM orders WHERE o_orderstatus = 'F')"""
_OWN = """nodes AS (SELECT 'c::' || c_custkey AS node_id, 'Class' AS node_type FROM customer UNION ALL SELECT 'o::' || o_orderkey, 'InterfaceField' FROM orders)"""


@query(f"WITH {_TREE}, {_OWN}, cis AS (SELECT node_id, node_type = 'Class' AS is_seed FROM nodes), lone AS (SELECT n FROM (SELECT source_id AS n, edge_type FROM edges UNION ALL SELECT target_id, edge_type FROM edges) JOIN cis ON n = node_id WHERE NOT is_seed GROUP BY n HAVING min(edge_type) = 'CONTAINS' AND max(edge_type) = 'CONTAINS'), fold AS (SELECT DISTINCT source_id AS parent, target_id AS child FROM edges JOIN lone ON target_id = n WHERE edge_type = 'CONTAINS' AND source_id IN (SELECT node_id FROM nodes WHERE node_type = 'Class')) SELECT c.node_id, coalesce(kids, '') AS kids FROM cis c LEFT JOIN (SELECT parent, string_agg(child, ',' ORDER BY child) AS kids FROM fold GROUP BY parent) f ON f.parent = c.node_id WHERE c.node_id NOT IN (SELECT child FROM fold)")
def collapse_contains(spark: SparkSession, d: str) -> DataFrame:
    """Orders as fields of their customers; finished ones have another edge too."""
    key = lambda p, c: F.concat(F.lit(p + "::"), F.col(c).cast("string"))
    o = fx.table(spark, d, "orders")
    edges = o.select(key("c", "o_custkey").alias("source_id"), key("o", "o_orderkey").alias("target_id"), F.lit("CONTAINS").alias("edge_type")).union(o.where("o_orderstatus = 'F'").select(key("o", "o_orderkey"), key("c", "o_custkey"), F.lit("CALLS")))
    nodes = fx.table(spark, d, "customer").select(key("c", "c_custkey").alias("node_id"), F.lit("Class").alias("node_type")).union(o.select(key("o", "o_orderkey"), F.lit("InterfaceField")))
    return G.collapse_fields(nodes.select("node_id", (F.col("node_type") == "Class").alias("is_seed")), nodes, edges).select("node_id", F.array_join("collapsed_children", ",").alias("kids"))


_SIB = f"{GRAPH}, anchor AS (SELECT file_path, min(n.node_id) AS anchor FROM nodes n JOIN (SELECT 's::' || s_suppkey AS node_id FROM supplier) USING (node_id) WHERE file_path IS NOT NULL GROUP BY file_path), sib AS (SELECT file_path, node_id, anchor, row_number() OVER (PARTITION BY file_path ORDER BY node_id) AS rank FROM nodes JOIN anchor USING (file_path) WHERE node_type IN ('Class', 'Enum', 'Function', 'Interface', 'Method', 'TypeAlias', 'Variable') AND node_id NOT LIKE 's::%')"


def _siblings(spark: SparkSession, d: str) -> DataFrame:
    cis = fx.table(spark, d, "supplier").select(F.concat(F.lit("s::"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return G.siblings(cis, fx.nodes(spark, d))


@query(f"{_SIB} SELECT file_path, node_id, anchor, rank FROM sib WHERE rank <= 12")
def file_siblings(spark: SparkSession, d: str) -> DataFrame:
    return _siblings(spark, d).select("file_path", "node_id", "anchor", F.col("rank").cast("bigint").alias("rank"))


@query(f"{_SIB} SELECT file_path, node_id FROM sib WHERE rank <= 4")
def sibling_caps(spark: SparkSession, d: str) -> DataFrame:
    return G.admit(_siblings(spark, d)).select("file_path", "node_id")


@query("SELECT 'c::' || c_custkey AS node_id, 'sis' AS kind FROM customer UNION ALL SELECT DISTINCT 'c::' || o_custkey, 'prop' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def cis_combine(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "customer").select(F.concat(F.lit("c::"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("sis").alias("kind"))
    p = fx.table(spark, d, "orders").select(F.concat(F.lit("c::"), F.col("o_custkey").cast("string")).alias("node_id"), F.lit("prop").alias("kind")).distinct()
    return G.combine(s, p)


_POOL = "pool AS (SELECT 's::' || s_suppkey AS node_id, s_acctbal / CAST(10000 AS DOUBLE) AS score FROM supplier)"
_LP = f"""{GRAPH}, {_POOL}, seed AS (SELECT node_id, greatest(score, CAST(0 AS DOUBLE)) AS m FROM pool ORDER BY score DESC, node_id LIMIT 5), h0 AS (SELECT node_id, m / (SELECT sum(m) FROM seed) AS m FROM seed),
link AS (SELECT source_id AS a, target_id AS b, weight AS w FROM edges JOIN config USING (edge_type) WHERE weight > 0 UNION ALL SELECT target_id, source_id, weight FROM edges JOIN config USING (edge_type) WHERE weight > 0),
h1 AS MATERIALIZED (SELECT b AS node_id, sum(m * w) AS m FROM h0 JOIN link ON a = node_id GROUP BY b), h2 AS MATERIALIZED (SELECT b AS node_id, sum(m * w) AS m FROM h1 JOIN link ON a = node_id GROUP BY b),
gs AS (SELECT node_id, greatest(sum(m), CAST(0 AS DOUBLE)) AS graph_score FROM (SELECT node_id, m FROM h1 UNION ALL SELECT node_id, m * CAST(0.5 AS DOUBLE) FROM h2) GROUP BY node_id),
bl AS (SELECT node_id, c, g, CAST(0.7 AS DOUBLE) * (c - c0) / CASE WHEN c1 > c0 THEN c1 - c0 ELSE 1 END + CAST(0.3 AS DOUBLE) * (g - g0) / CASE WHEN g1 > g0 THEN g1 - g0 ELSE 1 END AS blended FROM (SELECT *, min(c) OVER () AS c0, max(c) OVER () AS c1, min(g) OVER () AS g0, max(g) OVER () AS g1 FROM (SELECT p.node_id, greatest(score, CAST(0 AS DOUBLE)) AS c, coalesce(graph_score, CAST(0 AS DOUBLE)) AS g FROM pool p LEFT JOIN gs USING (node_id))))"""


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pool = fx.table(spark, d, "supplier").select(F.concat(F.lit("s::"), F.col("s_suppkey").cast("string")).alias("node_id"), (F.col("s_acctbal") / 10000.0).alias("score"))
    return pool, G.label_propagation(pool, fx.edges(spark, d), dims.edge_config(spark), written=written)


@query(f"{_LP} SELECT node_id, round(graph_score, 4) AS graph_score FROM gs")
def label_prop_2hop(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d)[1].select("node_id", F.round("graph_score", 4).alias("graph_score"))


@query(f"{_LP} SELECT node_id, round(blended, 4) AS blended FROM bl")
def graph_rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    return G.blend(*_labels(spark, d)).select("node_id", F.round("blended", 4).alias("blended"))


@query(f"{_LP}, mid AS (SELECT list_sort(list(blended))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS mid, min(g) AS g0, max(g) AS g1 FROM bl), new AS (SELECT node_id, graph_score FROM gs WHERE node_id NOT IN (SELECT node_id FROM pool) ORDER BY round(graph_score, 9) DESC, node_id LIMIT 10) SELECT node_id, round(mid, 4) AS score, round(mid / 2, 4) AS rrf FROM new, mid WHERE (graph_score - g0) / CASE WHEN g1 > g0 THEN g1 - g0 ELSE 1 END >= CAST(0.1 AS DOUBLE)")
def graph_add_mode(spark: SparkSession, d: str) -> DataFrame:
    pool, gs = _labels(spark, d)
    b = G.blend(pool, gs)
    near = gs.withColumn("graph_score", F.round("graph_score", 9))
    return G.discovered(pool, near, fx.nodes(spark, d), b).select("node_id", F.round("score", 4).alias("score"), F.round("rrf", 4).alias("rrf"))


# Verdicts: the labels of documents stand for those of a provider.
_CAND = "cand AS (SELECT lang AS cr, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 5) AS BIGINT) AS batch, 'd' || doc_id AS node_id FROM documents)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    x = fx.table(spark, d, "documents").select(F.col("lang").alias("cr"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), "doc_id")
    return V.batches(x, ["doc_id"])


@query(f"WITH {_CAND} SELECT cr, batch, node_id FROM cand JOIN labels ON 'd' || doc_id = node_id WHERE quality = 1 AND doc_id % 7 <> 0")
def verdict_failclosed(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts come with delimiters around their ids; those of ids that 7 divides are of another batch and count for nothing."""
    c = _candidates(spark, d)
    v = c.join(fx.table(spark, d, "labels"), "doc_id").select("cr", F.when(F.col("doc_id") % 7 == 0, F.col("batch") + 1).otherwise(F.col("batch")).alias("batch"), F.concat(F.lit("<"), "node_id", F.lit(">")).alias("node_id"), (F.col("quality") == 1).alias("confirmed"), F.lit("").alias("justification"))
    return V.confirmed(c.drop("doc_id"), v).select("cr", "batch", "node_id")


@query("""WITH v AS (SELECT c_nationkey AS cr, 'd' || c_custkey AS doc_id, 'c' || (o_orderkey % 100) AS code_id, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'PARTIAL' ELSE 'REJECTED' END AS decision FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY cr, code_id ORDER BY CASE decision WHEN 'CONFIRMED' THEN 0 WHEN 'PARTIAL' THEN 1 ELSE 2 END, ord) AS rn FROM v WHERE decision <> 'REJECTED') SELECT cr, code_id, decision, decision <> 'CONFIRMED' AS low, doc_id AS justification FROM r WHERE rn = 1""")
def trace_best_decision(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = F.col("o_orderstatus")
    x = o.select(F.col("c_nationkey").alias("cr"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doc"), F.concat(F.lit("c"), (F.col("o_orderkey") % 100).cast("string")).alias("code_id"), F.col("o_orderkey").alias("ord"), F.when(s == "F", "CONFIRMED").when(s == "O", "PARTIAL").otherwise("REJECTED").alias("decision"))
    x = x.withColumn("doc_id", F.concat("doc", F.lit("/"), F.col("ord").cast("string")))
    return V.best_decisions(x.select("cr", "doc_id", "code_id", "ord"), x.select("cr", "doc_id", "code_id", "decision", F.col("doc").alias("justification")))


@query(f"{GRAPH}, {SEEDS}, {sql_bfs(20)} SELECT node_id, depth = 1 AND edge IN ('IMPLEMENTS', 'DEFINES_METHOD') AS auto FROM cis WHERE NOT is_seed")
def autoexempt_split(spark: SparkSession, d: str) -> DataFrame:
    return V.auto_kept(impact_set(spark, d, 20).where(~F.col("is_seed"))).select("node_id", "auto")


@query("WITH k AS (SELECT 's' || source AS node_id, 'd' || doc_id AS child FROM documents) SELECT node_id, coalesce(string_agg(child, ',' ORDER BY child) FILTER (WHERE doc_id IS NOT NULL), '') AS kept FROM k LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON 'd' || doc_id = child GROUP BY node_id")
def child_filter(spark: SparkSession, d: str) -> DataFrame:
    cis = fx.table(spark, d, "documents").groupBy(F.concat(F.lit("s"), "source").alias("node_id")).agg(F.collect_list(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("collapsed_children"))
    v = fx.table(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), (F.col("quality") == 1).alias("semantically_impacted"))
    return V.children(cis, v).select("node_id", F.array_join("collapsed_children", ",").alias("kept"))


@query("""SELECT 'd' || d.doc_id AS node_id, CASE WHEN quality = 1 THEN 'mechanism of ' || d.doc_id WHEN toxic = 1 THEN 'trace of ' || d.doc_id WHEN lang = 'en' THEN 'Retrieved for the request' ELSE 'Reached by CALLS > ' || source END AS justification,
CASE WHEN quality = 1 AND lang = 'en' THEN 'llm2_sis' WHEN lang = 'en' AND toxic = 1 THEN 'llm3_trace' WHEN lang = 'en' THEN 'retrieval' ELSE 'structural' END AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE lang = 'en'
UNION ALL SELECT 'd' || d.doc_id, CASE WHEN toxic = 1 THEN 'reached ' || d.doc_id ELSE 'Reached by CALLS > ' || source END, CASE WHEN toxic = 1 THEN 'llm4_propagation' ELSE 'structural' END FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE lang <> 'en'""")
def justify_attach(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    cis = fx.table(spark, d, "documents").select(key.alias("node_id"), (F.col("lang") == "en").alias("is_seed"), F.array(F.lit("CALLS"), F.col("source")).alias("chain"))
    l = fx.table(spark, d, "labels")
    note = lambda p: F.concat(F.lit(p + " "), F.col("doc_id").cast("string"))
    sis = l.where("quality = 1").select(key.alias("node_id"), note("mechanism of").alias("mechanism"), F.lit("").alias("text"))
    return V.justify(cis, sis, l.where("toxic = 1").select(key.alias("node_id"), note("trace of").alias("text")), l.where("toxic = 1").select(key.alias("node_id"), note("reached").alias("text")))


@query("WITH t AS (SELECT conv_id, CAST(floor(turn / 5) AS BIGINT) AS batch, turn, role || ': ' || substr(text, 1, 500) AS line FROM conversations) SELECT conv_id AS cr, batch, string_agg(line, chr(10) ORDER BY turn) AS prompt, count(*) AS n FROM t GROUP BY conv_id, batch")
def prompt_batches(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("cr"), F.floor(F.col("turn") / 5).cast("bigint").alias("batch"), F.lpad(F.col("turn").cast("string"), 9, "0").alias("node_id"), "role", "text")
    return V.prompts(c, F.concat("role", F.lit(": "), F.substring("text", 1, 500)))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') AND length(source) > 4 THEN source WHEN lang <> 'es' THEN 'source: ' || text ELSE text END AS snippet FROM documents")
def snippet_pick(spark: SparkSession, d: str) -> DataFrame:
    lang = F.col("lang")
    kind = F.when(lang == "en", "Function").when(lang == "de", "Method").otherwise("Class")
    return fx.table(spark, d, "documents").select("doc_id", P.snippet(kind, F.when(F.length("source") > 4, F.col("source")).otherwise(""), F.when(lang != "es", F.concat(F.lit("source: "), "text")), F.col("text")).alias("snippet"))


@query("WITH r AS (SELECT lang AS cr, doc_id AS node_id, doc_id % 9 = 0 AS is_seed, row_number() OVER (PARTITION BY lang, doc_id % 9 = 0 ORDER BY n_chars % 3, n_chars % 4, doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n, sum(CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY lang) AS s FROM documents) SELECT cr, node_id FROM r WHERE n * 2000 <= 240000 OR is_seed OR p <= greatest(0, 120 - s)")
def hard_limit(spark: SparkSession, d: str) -> DataFrame:
    sev = fx.pick(F.col("n_chars") % 3, [dims.HIGH, dims.MEDIUM, dims.LOW])
    cis = fx.table(spark, d, "documents").select(F.col("lang").alias("cr"), F.col("doc_id").alias("node_id"), (F.col("doc_id") % 9 == 0).alias("is_seed"), sev.alias("severity"), (F.col("n_chars") % 4).alias("depth"))
    return P.hard_limit(cis).select("cr", "node_id")


@query("""WITH RECURSIVE b AS (SELECT conv_id, turn, CAST(floor(length(text) / 4) AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS used, '' AS kept FROM (SELECT DISTINCT conv_id FROM b) UNION ALL
SELECT f.conv_id, b.i, CASE WHEN used + c <= 300 THEN used + c ELSE used END, CASE WHEN used + c <= 300 THEN kept || CASE WHEN kept = '' THEN '' ELSE ',' END || turn ELSE kept END FROM f JOIN b ON b.conv_id = f.conv_id AND b.i = f.i + 1)
SELECT conv_id, used, kept FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS r FROM f) WHERE r = 1""")
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "conversations").withColumn("cost", token_estimate(F.col("text")))
    return P.pack_blocks(c, "conv_id", "turn", "cost", 300).select("conv_id", "used", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))


_ENT = "ent AS (SELECT source AS file_path, 'd' || doc_id AS node_id, CASE n_chars % 3 WHEN 0 THEN 'Tinggi' WHEN 1 THEN 'Menengah' ELSE 'Rendah' END AS severity, n_chars % 3 AS rank, text AS justification FROM documents)"


@query(f"WITH {_ENT} SELECT file_path, count(*) AS entities, CASE min(rank) WHEN 0 THEN 'Tinggi' WHEN 1 THEN 'Menengah' ELSE 'Rendah' END AS severity, arg_min(justification, lpad(CAST(rank AS VARCHAR), 2, '0') || node_id) AS sample FROM ent GROUP BY file_path")
def file_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "documents").select(F.col("source").alias("file_path"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), fx.pick(F.col("n_chars") % 3, [dims.HIGH, dims.MEDIUM, dims.LOW]).alias("severity"), F.col("text").alias("justification"))
    return P.file_rollup(e).select("file_path", "entities", "severity", "sample")


@query(f"{GRAPH}, {SEEDS}, {sql_bfs(20)} SELECT node_id, node_type, file_path, severity, depth FROM cis JOIN nodes USING (node_id) WHERE node_type <> 'File' AND node_id LIKE '%::%'")
def entity_rows(spark: SparkSession, d: str) -> DataFrame:
    cis = impact_set(spark, d, 20)
    none = cis.select("node_id", F.lit("").alias("justification"), F.lit("").alias("source")).limit(0)
    return P.entity_rows(cis, fx.nodes(spark, d), none).select("node_id", "node_type", "file_path", "severity", "depth")


@query("SELECT source AS cr, lang AS file_path, row_number() OVER (PARTITION BY source ORDER BY min(doc_id), lang) AS ord FROM documents GROUP BY source, lang")
def file_list(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "documents").select(F.col("source").alias("cr"), F.col("lang").alias("file_path"), F.col("doc_id").alias("ord"))
    return P.file_list(e).withColumn("ord", F.col("ord").cast("bigint"))


@query("SELECT o_custkey AS cr, count(*) AS n, CASE WHEN count(*) <= 10 THEN 'terlokalisasi' WHEN count(*) <= 30 THEN 'menengah' ELSE 'ekstensif' END AS scope FROM orders GROUP BY o_custkey")
def scope_class(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cr")).agg(F.count("*").alias("n")).withColumn("scope", scope(F.col("n")))


# Audits of the graph
@query(f"{GRAPH} SELECT edge_type, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM edges), 6) AS pct FROM edges GROUP BY edge_type")
def type_counts_pct(spark: SparkSession, d: str) -> DataFrame:
    return A.counts(fx.edges(spark, d), "edge_type").select("edge_type", "n", F.round("pct", 6).alias("pct"))


@query(f"{GRAPH} SELECT (SELECT count(*) FROM edges) AS edges, count(*) AS nodes, round((SELECT count(*) FROM edges) / CAST(count(*) AS DOUBLE), 6) AS density FROM nodes WHERE node_type NOT IN ('ExternalPackage', 'InterfaceField')")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return A.density(fx.nodes(spark, d), fx.edges(spark, d)).select("edges", "nodes", F.round("density", 6).alias("density"))


@query(f"{GRAPH}, own AS MATERIALIZED (SELECT source_id AS node_id FROM edges WHERE edge_type NOT IN ('CALLS', 'DEFINES_METHOD') UNION SELECT target_id FROM edges WHERE edge_type NOT IN ('CALLS', 'DEFINES_METHOD')) SELECT node_id, node_type FROM nodes ANTI JOIN own USING (node_id)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without structural edges, calls left aside"""
    return A.orphans(fx.nodes(spark, d), fx.edges(spark, d).where(~F.col("edge_type").isin("CALLS", "DEFINES_METHOD"))).select("node_id", "node_type")


@query(f"{GRAPH} SELECT node_id, CASE WHEN t THEN 'sink' ELSE 'source' END AS kind FROM (SELECT node_id, node_id IN (SELECT target_id FROM edges) AS t, node_id IN (SELECT source_id FROM edges) AS s FROM nodes) WHERE t <> s")
def sinks_sources(spark: SparkSession, d: str) -> DataFrame:
    return A.ends(fx.nodes(spark, d), fx.edges(spark, d))


@query(f"{GRAPH}, {DEG} SELECT node_id, node_type, in_degree, out_degree, degree AS total FROM nodes JOIN deg USING (node_id) ORDER BY degree DESC, node_id LIMIT 10")
def top_degree_or_join(spark: SparkSession, d: str) -> DataFrame:
    return A.top_degree(fx.nodes(spark, d), fx.edges(spark, d))


@query(f"WITH {fx.SQL_MATRIX}, e AS (SELECT min(score) AS lo, (max(score) - min(score)) / CAST(5 AS DOUBLE) AS w FROM matrix) SELECT CAST(CASE WHEN w > 0 THEN least(floor((score - lo) / w), 4) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM matrix, e GROUP BY 1")
def score_hist5(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(fx.matrix(spark, d), "score")


@query(f"WITH {fx.SQL_MATRIX} SELECT count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS stdev FROM matrix")
def dist_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(fx.matrix(spark, d), "score").select("n", "min", "max", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


@query(f"WITH {fx.SQL_MATRIX} SELECT 'd' || vec_id AS doc_id FROM embeddings WHERE 'd' || vec_id NOT IN (SELECT doc_id FROM matrix)")
def stranded(spark: SparkSession, d: str) -> DataFrame:
    return A.stranded(fx.doc_vectors(spark, d), fx.matrix(spark, d))


@query(f"WITH {fx.SQL_MATRIX} SELECT count(*) AS n, min(k) AS min, max(k) AS max, round(avg(k), 6) AS mean, round(coalesce(stddev_samp(k), 0), 6) AS stdev FROM (SELECT count(*) AS k FROM matrix GROUP BY doc_id)")
def candidates_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return A.per_doc(fx.matrix(spark, d)).select("n", "min", "max", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


@query("""SELECT 'lineitem.order' AS "constraint", count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'labels.document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'documents.key', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1) UNION ALL SELECT 'documents.lang', count(*) FROM documents WHERE lang NOT IN ('en', 'de')""")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: fx.table(spark, d, n)
    rows = [A.broken_keys(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lineitem.order"), A.broken_keys(t("orders"), "o_custkey", t("customer"), "c_custkey", "orders.customer"), A.broken_keys(t("labels"), "doc_id", t("documents"), "doc_id", "labels.document"), A.broken_keys(t("lineitem"), "l_partkey", t("part"), "p_partkey", "lineitem.part"), A.duplicate_keys(t("documents"), ["doc_id"], "documents.key"), A.outside(t("documents"), "lang", ["en", "de"], "documents.lang")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT (SELECT count(*) FROM embeddings) AS stored, (SELECT count(*) FROM documents WHERE length(text) >= 50) AS expected, (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents WHERE length(text) >= 50) AS aligned")
def store_alignment(spark: SparkSession, d: str) -> DataFrame:
    return A.aligned(fx.table(spark, d, "embeddings"), fx.table(spark, d, "documents").where(F.length("text") >= 50))


@query("WITH a AS (SELECT source AS cr, doc_id AS node_id, min(ord) AS first_at FROM (SELECT source, doc_id, doc_id AS ord FROM documents WHERE lang = 'en' UNION ALL SELECT source, doc_id, 1000000000 + n_chars FROM documents) GROUP BY source, doc_id) SELECT cr, node_id, row_number() OVER (PARTITION BY cr ORDER BY first_at, node_id) AS ord FROM a")
def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    x = fx.table(spark, d, "documents").select(F.col("source").alias("cr"), F.col("doc_id").alias("node_id"), "lang", "n_chars")
    return R.merge_seeds(x.where("lang = 'en'").withColumn("ord", F.col("node_id")), x.withColumn("ord", F.col("n_chars"))).withColumn("ord", F.col("ord").cast("bigint"))
