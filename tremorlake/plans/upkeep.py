"""Queries of interpretation, scoring contracts, report assembly, maintenance, scalar rules and extraction, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dims, text as X
from ..operators import audit as A, evaluation as E, extraction as T, incremental as I, interpretation as N, reports as P, rescoring as R, verdicts as J
from . import analyze as Z, analyze_sql as SQL, fixtures as fx
from .registry import query
from .store import written


def _key(p: str, c: str):
    return F.concat(F.lit(p), F.col(c).cast("string"))


# Interpretation
_WORDS = r"w AS (SELECT item_id AS cr, item_id % 3 AS k, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, text FROM benchmark)"


@query(f"""WITH {_WORDS} SELECT cr, cr % 10 <> 9 AND cr % 11 <> 0 AS actionable, CASE WHEN cr % 11 = 0 THEN 'The request has no interpretation' WHEN cr % 10 = 9 THEN 'too vague' END AS reason, CASE WHEN cr % 11 = 0 OR k = 1 THEN 'MODIFICATION' WHEN k = 0 THEN 'ADDITION' ELSE 'DELETION' END AS change_type,
CASE WHEN cr % 11 = 0 THEN '' WHEN k = 0 THEN 'code,requirement' WHEN k = 1 THEN 'design,code' ELSE 'requirement,code' END AS layers, CASE WHEN cr % 11 = 0 THEN 0 ELSE 2 END AS n_queries FROM w""")
def interpret_requests(spark: SparkSession, d: str) -> DataFrame:
    """Readings of requests, of which some are missing, with layers that don't fit the change."""
    given = Z.interpretations(spark, d).where("cr % 11 <> 0")
    given = given.withColumn("layers", F.when(F.col("cr") % 3 == 0, F.array(F.lit("code"))).when(F.col("cr") % 3 == 1, F.col("layers")).otherwise(F.array(F.lit("requirement"))))
    return N.interpreted(fx.requests(spark, d), given).select("cr", "actionable", "reason", "change_type", F.array_join("layers", ",").alias("layers"), F.size("queries").alias("n_queries"))


@query(f"""WITH {_WORDS}, l AS (SELECT * FROM w WHERE cr % 10 <> 9) SELECT cr, 0 AS q, array_to_string(w[1:greatest(1, len(w) // 2)], ' ') AS text FROM l UNION ALL SELECT cr, 1, array_to_string(w[greatest(1, len(w) // 2) + 1:], ' ') FROM l UNION ALL SELECT cr, -1, text FROM l""")
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    """Search texts, and the raw request as one more."""
    req = fx.requests(spark, d)
    return N.search_texts(N.interpreted(req, Z.interpretations(spark, d)), req)


@query(f"""WITH {fx.SQL_CODES}, q AS (SELECT item_id % 5 AS cr, list_distinct({fx.sql_tokens('text')}) AS t FROM benchmark), c AS (SELECT id, file_class, list_distinct(CASE WHEN name <> '' AND file_class IS NOT NULL THEN {fx.sql_tokens('name')} ELSE {fx.sql_tokens('text')} END) AS t FROM codes)
SELECT cr, id AS node_id, round(max(CAST(len(list_intersect(q.t, c.t)) AS DOUBLE) / greatest(len(q.t), 1)), 6) AS raw FROM q, c GROUP BY cr, id""")
def cross_encoder(spark: SparkSession, d: str) -> DataFrame:
    """The largest score of several queries for each candidate, of its abstraction or else its text."""
    q = fx.requests(spark, d).select((F.col("cr") % 5).alias("cr"), "text")
    codes = fx.codes(spark, d)
    texts = codes.select(F.col("id").alias("node_id"), F.when(F.col("file_class").isNotNull(), F.col("name")).alias("abstraction"), F.col("text").alias("snippet"))
    pool = q.select("cr").distinct().join(codes.select(F.col("id").alias("node_id")))
    return R.cross_encode(pool, texts, q).select("cr", "node_id", "raw")


# Verdicts and reports
@query("SELECT lang AS cr, source AS file_path, 'd' || doc_id AS node_id, 'with ' || doc_id AS justification FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 5 <> 0")
def sibling_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts by file; those that ids which 5 divides got in the call for another file count for nothing."""
    x = fx.table(spark, d, "documents").select(F.col("lang").alias("cr"), F.col("source").alias("file_path"), _key("d", "doc_id").alias("node_id"), "doc_id")
    v = x.join(fx.table(spark, d, "labels"), "doc_id").select("cr", F.when(F.col("doc_id") % 5 == 0, "elsewhere").otherwise(F.col("file_path")).alias("file_path"), F.concat(F.lit("`"), "node_id", F.lit("`")).alias("node_id"), (F.col("quality") == 1).alias("semantically_impacted"), _key("with ", "doc_id").alias("justification"))
    return J.siblings(x.drop("doc_id"), v).select("cr", "file_path", "node_id", "justification")


@query("""WITH f AS (SELECT lang AS cr, source AS file_path, count(*) AS entities, arg_min(text, CASE n_chars % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END || 'd' || doc_id) AS sample FROM documents GROUP BY lang, source) SELECT cr, file_path, entities, CASE WHEN file_path IN ('src1', 'src2') THEN 'text of ' || file_path ELSE sample END AS justification FROM f""")
def synthesis(spark: SparkSession, d: str) -> DataFrame:
    """A provider's texts of files: what isn't in the report is dropped, what is blank or left out has the first entity's."""
    e = fx.table(spark, d, "documents").select(F.col("lang").alias("cr"), F.col("source").alias("file_path"), _key("d", "doc_id").alias("node_id"), fx.pick(F.col("n_chars") % 3, [dims.HIGH, dims.MEDIUM, dims.LOW]).alias("severity"), F.col("text").alias("justification"))
    told = spark.createDataFrame([(c, f, t) for c in ("en", "de", "fr", "es", "xx") for f, t in (("src1", "text of src1"), ("src2", "text of src2"), ("src3", "  "), ("nowhere", "made up"), (None, "made up"))], "cr string, file_path string, justification string")
    return P.file_rollup(e, J.summarised(e, told)).select("cr", "file_path", "entities", "justification")


@query("SELECT lang AS cr, doc_id AS node_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END, CASE WHEN doc_id % 4 = 0 THEN -n_chars END, CASE WHEN doc_id % 4 <> 0 THEN n_chars % 3 END, CASE WHEN doc_id % 4 <> 0 THEN n_chars % 5 END, doc_id) AS place FROM documents")
def priority_sort(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    x = fx.table(spark, d, "documents").select(F.col("lang").alias("cr"), F.col("doc_id").alias("node_id"), (F.col("doc_id") % 4 == 0).alias("is_seed"), F.col("n_chars").alias("score"), fx.pick(F.col("n_chars") % 3, [dims.HIGH, dims.MEDIUM, dims.LOW]).alias("severity"), (F.col("n_chars") % 5).alias("depth"))
    return x.select("cr", "node_id", F.row_number().over(Window.partitionBy("cr").orderBy(*P.order_of_report())).cast("bigint").alias("place"))


@query(f"WITH {fx.SQL_NODES} SELECT o_custkey % 7 AS cr, file_path FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN nodes ON node_id = 'r::' || n_regionkey WHERE node_type = 'File' GROUP BY 1, 2")
def extra_paths(spark: SparkSession, d: str) -> DataFrame:
    """The files of an impacted set of orders, customers and regions."""
    t = lambda n: fx.table(spark, d, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    cis = o.select((F.col("o_custkey") % 7).alias("cr"), F.explode(F.array(_key("r::", "n_regionkey"), _key("c::", "c_custkey"), _key("doc", "o_orderkey"))).alias("node_id"))
    return P.extra_paths(cis, fx.nodes(spark, d))


@query("""WITH e AS (SELECT source AS cr, 'f' || (doc_id % 20) || '::d' || doc_id AS node_id, 'f' || (doc_id % 20) AS file_path, CASE WHEN lang = 'es' THEN ' ' ELSE lang END AS justification, CASE WHEN lang = 'fr' THEN 'unknown' ELSE lang END AS source FROM documents WHERE n_chars % 4 = 0),
need AS (SELECT 'src' || i AS cr, 'F' || j AS needle FROM range(22) t(i), range(3) u(j)),
lost AS (SELECT n.cr, count(*) AS missing FROM need n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.cr = n.cr AND (contains(lower(e.node_id), lower(needle)) OR contains(lower(e.file_path), lower(needle)))) GROUP BY n.cr),
n AS (SELECT cr, count(*) AS n, count(*) FILTER (WHERE trim(justification) = '') AS unjustified FROM e GROUP BY cr), s AS (SELECT cr, string_agg(source || '=' || k, ',' ORDER BY source || '=' || k) AS sources FROM (SELECT cr, source, count(*) AS k FROM e GROUP BY cr, source) GROUP BY cr),
x AS (SELECT cr, coalesce(n, 0) AS n, coalesce(unjustified, 0) AS unjustified, coalesce(missing, 0) AS missing, coalesce(sources, '') AS sources FROM n FULL JOIN (SELECT DISTINCT cr FROM need) USING (cr) LEFT JOIN lost USING (cr) LEFT JOIN s USING (cr))
SELECT *, n > 0 AND n < 200 AND unjustified = 0 AND missing = 0 AS passed FROM x""")
def report_check(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.lit("f"), (F.col("doc_id") % 20).cast("string"))
    lang = F.col("lang")
    e = fx.table(spark, d, "documents").where("n_chars % 4 = 0").select(F.col("source").alias("cr"), F.concat(file, F.lit("::d"), F.col("doc_id").cast("string")).alias("node_id"), file.alias("file_path"), F.when(lang == "es", " ").otherwise(lang).alias("justification"), F.when(lang != "fr", lang).otherwise("").alias("source"))
    need = spark.range(22).select(_key("src", "id").alias("cr")).join(spark.range(3).select(_key("F", "id").alias("needle")))
    return E.quality_check(e, need)


@query(f"""WITH {fx.SQL_MATRIX}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code_id) AS r FROM matrix)
SELECT doc_id, bool_or(r = 1 AND hit) AS top1, bool_or(hit) AS topk FROM (SELECT doc_id, r, CASE doc_id WHEN 'd1' THEN contains(code_id, '1') WHEN 'd2' THEN contains(code_id, '2') OR contains(code_id, '3') ELSE false END AS hit FROM t WHERE r <= 3) GROUP BY doc_id""")
def benchmark_hits(spark: SparkSession, d: str) -> DataFrame:
    names = fx.code_vectors(spark, d).select(F.col("code_id").alias("node_id"), F.col("code_id").alias("name"))
    return A.benchmark_hits(fx.matrix(spark, d), names, {"d1": ["1"], "d2": ["2", "3"]})


# Maintenance
@query("""SELECT 'chunks' AS part, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT 'pairs', count(*) FROM labels JOIN documents USING (doc_id) WHERE source NOT IN ('src1', 'src2')""")
def purge_documents(spark: SparkSession, d: str) -> DataFrame:
    x = fx.table(spark, d, "documents")
    left = I.purge_documents(x.select("doc_id", F.col("source").alias("source_file")), fx.table(spark, d, "labels").select("doc_id"), spark.createDataFrame([("src1",), ("src2",)], "file_path string"))
    one = lambda k: left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n")
    return one("chunks").unionByName(one("pairs"))


@query(f"WITH {fx.SQL_NODES}, {fx.SQL_EDGES} SELECT edge_type, count(*) AS n FROM edges WHERE source_id NOT IN (SELECT node_id FROM nodes WHERE file_path IN ('r::1', 'n::3', 'n::4')) GROUP BY edge_type")
def stale_edges(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame([("r::1",), ("n::3",), ("n::4",)], "file_path string")
    return I.drop_outgoing(fx.edges(spark, d), fx.nodes(spark, d), files).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'n' || n_nationkey AS dependent_file, 'r' || n_regionkey AS target_file FROM nation WHERE n_nationkey % 3 <> 0")
def stale_dependencies(spark: SparkSession, d: str) -> DataFrame:
    n = fx.table(spark, d, "nation")
    deps = n.select(_key("n", "n_nationkey").alias("dependent_file"), _key("r", "n_regionkey").alias("target_file"))
    return I.drop_dependencies(deps, n.where("n_nationkey % 3 = 0").select(_key("n", "n_nationkey").alias("file_path")))


@query(f"WITH {fx.SQL_NODES}, {fx.SQL_EDGES} SELECT DISTINCT s.file_path AS dependent_file, t.file_path AS target_file FROM edges JOIN nodes s ON s.node_id = source_id JOIN nodes t ON t.node_id = target_id WHERE s.file_path <> t.file_path")
def file_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies of files from edges, each once, put into a table that has some of them already."""
    found = I.dependencies(fx.edges(spark, d), fx.nodes(spark, d))
    return I.insert_ignore(found.where(F.length("target_file") % 2 == 0), found, ["dependent_file", "target_file"])


@query("SELECT vec_id, CASE WHEN label < 5 THEN label + 100 ELSE label END AS label FROM embeddings WHERE label <> 7 UNION ALL SELECT vec_id + 1000000, 7 FROM embeddings WHERE label = 7")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label renewed by id, and those of another replaced as a group."""
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    renewed = I.replace(e, e.where("label < 5").withColumn("label", F.col("label") + 100), "vec_id")
    return I.replace(renewed, e.where("label = 7").withColumn("vec_id", F.col("vec_id") + 1000000), "label")


# Scalar rules
@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(source || 'PageOf' || upper(lang), '([A-Z])', ' \1', 'g'), ' +', ' ', 'g')) AS readable, 'd' || doc_id AS last, source || '::x' AS file, substr(sha256(text), 1, 16) AS hash,
contains(lower(text), ' yang ') OR contains(lower(text), ' untuk ') OR contains(lower(text), ' dan ') OR contains(lower(text), ' dengan ') OR contains(lower(text), 'tambahkan') OR contains(lower(text), 'menambahkan') AS indonesian, length(substr(text, 1, 1200)) AS abstraction, length(substr(text, 1, 800)) AS sibling, length(substr(text, 1, 300)) AS reason FROM documents""")
def scalar_text(spark: SparkSession, d: str) -> DataFrame:
    x = fx.table(spark, d, "documents")
    node = F.concat_ws("::", "source", F.lit("x"), _key("d", "doc_id"))
    cut = lambda k: F.length(X.shortened(F.col("text"), k)).cast("bigint").alias(k)
    return x.select("doc_id", X.readable_name(F.concat("source", F.lit("PageOf"), F.upper("lang"))).alias("readable"), X.last_segment(node).alias("last"), X.file_part(node).alias("file"), X.short_hash(F.col("text")).alias("hash"), X.is_indonesian(F.col("text")).alias("indonesian"), cut("abstraction"), cut("sibling"), cut("reason"))


_LAYER_ROWS = [(0, "requirement"), (1, "design"), (2, "code"), (3, "code,design"), (4, "design,requirement,design"), (5, "")]


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'requirement' WHEN 1 THEN 'design' WHEN 2 THEN 'code' WHEN 3 THEN 'code,design' WHEN 4 THEN 'design,requirement,design' ELSE '' END AS l, CASE n_chars % 3 WHEN 0 THEN 'ADDITION' WHEN 1 THEN 'MODIFICATION' ELSE 'DELETION' END AS c FROM documents)
SELECT doc_id, CASE l WHEN 'requirement' THEN 'FR,NFR' WHEN 'design' THEN 'Design' WHEN 'code' THEN 'General' WHEN 'code,design' THEN 'General,Design' WHEN '' THEN '' ELSE 'Design,FR,NFR' END AS kinds, CASE WHEN contains(l, 'code') OR contains(l, 'requirement') THEN 'FR' WHEN contains(l, 'design') THEN 'Design' ELSE 'General' END AS prim,
CASE WHEN c = 'DELETION' THEN CASE l WHEN '' THEN 'code' WHEN 'design,requirement,design' THEN 'design,requirement,code' WHEN 'requirement' THEN 'requirement,code' WHEN 'design' THEN 'design,code' ELSE l END WHEN c = 'ADDITION' AND l = 'code' THEN 'code,requirement' ELSE l END AS layers FROM l""")
def layer_rules(spark: SparkSession, d: str) -> DataFrame:
    l = F.filter(F.split(fx.pick(F.col("doc_id") % 6, [x for _, x in _LAYER_ROWS]), ","), lambda x: x != "")
    c = fx.pick(F.col("n_chars") % 3, fx.CHANGES)
    return fx.table(spark, d, "documents").select("doc_id", F.array_join(X.layers_to_chunk_types(l), ",").alias("kinds"), R.primary_chunk(l).alias("prim"), F.array_join(X.coherent_layers(c, l), ",").alias("layers"))


@query("SELECT event_id, epoch_us(ts) AS us, ts >= TIMESTAMP '2024-01-15' AS late FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, -1, false FROM events WHERE event_id % 4 = 3")
def instants(spark: SparkSession, d: str) -> DataFrame:
    """Times written with Z, with an offset and without a zone, read again; other text is null."""
    iso = lambda ts, f: F.date_format(ts, f)
    ts = F.col("ts")
    written_ = F.when(F.col("event_id") % 4 == 0, F.concat(iso(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(iso(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))).when(F.col("event_id") % 4 == 2, iso(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("yesterday")
    at = X.instant(written_)
    return fx.table(spark, d, "events").select("event_id", F.coalesce(F.unix_micros(at), F.lit(-1)).alias("us"), F.coalesce(at >= F.lit("2024-01-15T00:00:00+00:00").cast("timestamp"), F.lit(False)).alias("late"))


@query("""SELECT doc_id, substr(sha256('{"a":"' || source || '","b":"' || lang || '"}'), 1, 16) AS hash FROM documents""")
def config_hashes(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", X.config_hash(F.struct(F.col("source").alias("a"), F.col("lang").alias("b"))).alias("hash"))


# Index
@query(f"""{SQL._BASE} SELECT 'total_code_nodes' AS key, count(*) AS value FROM nodes UNION ALL SELECT 'total_structural_edges', count(*) FROM edges UNION ALL SELECT 'total_doc_chunks', count(DISTINCT id) FROM ed UNION ALL SELECT 'total_doc_code_candidates', count(*) FROM matrix""")
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    return Z.fixture(spark, d).totals()


# Extraction from generated TypeScript: a file for each nation and customer
def repository(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a nation's class and function, and each customer's symbols that use them."""
    fill = lambda text, **by: _filled(text, by)
    n = fx.table(spark, d, "nation").select(F.concat(F.lit("src/lib/n"), F.col("n_nationkey").cast("string"), F.lit(".ts")).alias("path"), fill("export class N{n} {\n  id(): string {\n    return ''\n  }\n}\n\nexport function helper{n}(x: N{n}) {\n  return x\n}\n", n="n_nationkey").alias("content"))
    c = fx.table(spark, d, "customer").select(
        F.concat(F.lit("src/lib/c"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("path"),
        fill("import { N{n}, helper{n} } from './n{n}'\nimport axios from 'axios'\n\n/** Customer {c}. */\nexport class C{c} extends N{n} {\n  run(x: N{n}): void {\n    helper{n}(x)\n  }\n}\n\nexport interface I{c} {\n  owner: C{c};\n}\n\nexport const load{c} = (id: string) => helper{n}(id)\n", n="c_nationkey", c="c_custkey").alias("content"),
    )
    return n.unionByName(c)


def _filled(text: str, by: dict[str, str]):
    parts = [text]
    for name, column in by.items():
        parts = [y for x in parts for y in ([x] if not isinstance(x, str) else [z for piece in x.split("{" + name + "}") for z in (piece, F.col(column).cast("string"))][:-1])]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


@query("""WITH n AS (SELECT n_nationkey AS n, 'src/lib/n' || n_nationkey || '.ts' AS f FROM nation), c AS (SELECT c_custkey AS c, c_nationkey AS n, 'src/lib/c' || c_custkey || '.ts' AS f FROM customer)
SELECT f AS node_id, 'File' AS node_type, f AS file_path, false AS exported, 'UTILITY' AS file_classification, NULL AS docstring FROM n UNION ALL SELECT f || '::N' || n, 'Class', f, true, 'UTILITY', NULL FROM n UNION ALL SELECT f || '::N' || n || '.id', 'Method', f, true, 'UTILITY', NULL FROM n UNION ALL SELECT f || '::helper' || n, 'Function', f, true, 'UTILITY', NULL FROM n
UNION ALL SELECT f, 'File', f, false, 'UTILITY', NULL FROM c UNION ALL SELECT DISTINCT 'ext::axios', 'ExternalPackage', NULL, false, NULL, NULL FROM c UNION ALL SELECT f || '::C' || c, 'Class', f, true, 'UTILITY', 'Customer ' || c || '.' FROM c UNION ALL SELECT f || '::C' || c || '.run', 'Method', f, true, 'UTILITY', NULL FROM c
UNION ALL SELECT f || '::I' || c, 'Interface', f, true, NULL, NULL FROM c UNION ALL SELECT f || '::I' || c || '.owner', 'InterfaceField', f, true, NULL, NULL FROM c UNION ALL SELECT f || '::load' || c, 'Function', f, true, 'UTILITY', NULL FROM c""")
def code_nodes(spark: SparkSession, d: str) -> DataFrame:
    return T.nodes(repository(spark, d), written).select("node_id", "node_type", "file_path", "exported", "file_classification", "docstring")


@query("""WITH n AS (SELECT n_nationkey AS n, 'src/lib/n' || n_nationkey || '.ts' AS f FROM nation), c AS (SELECT c_custkey AS c, c_nationkey AS n, 'src/lib/c' || c_custkey || '.ts' AS f, 'src/lib/n' || c_nationkey || '.ts' AS g FROM customer)
SELECT f AS source_id, f || '::N' || n AS target_id, 'CONTAINS' AS edge_type FROM n UNION ALL SELECT f, f || '::helper' || n, 'CONTAINS' FROM n UNION ALL SELECT f || '::N' || n, f || '::N' || n || '.id', 'DEFINES_METHOD' FROM n UNION ALL SELECT f || '::helper' || n, f || '::N' || n, 'TYPED_BY' FROM n
UNION ALL SELECT f, f || '::C' || c, 'CONTAINS' FROM c UNION ALL SELECT f, f || '::I' || c, 'CONTAINS' FROM c UNION ALL SELECT f, f || '::load' || c, 'CONTAINS' FROM c UNION ALL SELECT f || '::I' || c, f || '::I' || c || '.owner', 'CONTAINS' FROM c
UNION ALL SELECT f, g, 'IMPORTS' FROM c UNION ALL SELECT f, 'ext::axios', 'DEPENDS_ON_EXTERNAL' FROM c UNION ALL SELECT f || '::C' || c, g || '::N' || n, 'INHERITS' FROM c UNION ALL SELECT f || '::C' || c, f || '::C' || c || '.run', 'DEFINES_METHOD' FROM c
UNION ALL SELECT f || '::C' || c || '.run', g || '::N' || n, 'TYPED_BY' FROM c UNION ALL SELECT f || '::C' || c || '.run', g || '::helper' || n, 'CALLS' FROM c UNION ALL SELECT f || '::load' || c, g || '::helper' || n, 'CALLS' FROM c UNION ALL SELECT f || '::I' || c || '.owner', f || '::C' || c, 'TYPED_BY' FROM c""")
def code_edges(spark: SparkSession, d: str) -> DataFrame:
    return T.edges(repository(spark, d), written=written)
