"""Queries of evaluation, maintenance and text transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import evaluation as E, extraction as T, incremental as I
from . import fixtures as fx
from .registry import query
from .store import written

VARIANTS = [f"V{i}" for i in range(8)]
_GT = "gt AS (SELECT lang AS cr, doc_id AS item, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"
_PRED = "pred AS (SELECT lang AS cr, 'V' || v AS variant, doc_id AS item, source, n_chars FROM documents, (SELECT unnest(range(8)) AS v) WHERE (doc_id + n_chars) % (v + 2) = 0)"


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Documents of quality 1 are what each language, as a request, should find."""
    return fx.table(spark, d, "documents").join(fx.table(spark, d, "labels").where("quality = 1"), "doc_id").select(F.col("lang").alias("cr"), F.col("doc_id").alias("item"), "source")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    v = F.explode(F.array(*[F.lit(i) for i in range(8)])).alias("v")
    x = fx.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", v).where((F.col("doc_id") + F.col("n_chars")) % (F.col("v") + 2) == 0)
    return x.select(F.col("lang").alias("cr"), F.concat(F.lit("V"), F.col("v").cast("string")).alias("variant"), F.col("doc_id").alias("item"), "source", "n_chars")


def _prf_sql(item: str, cols: str) -> str:
    return f"""SELECT cr, variant, tp, n_pred, n_gt, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN n_gt = 0 THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (SELECT cr, variant, count(*) AS n_pred, count(g) AS tp, max(n_gt) AS n_gt, count(g) / CAST(count(*) AS DOUBLE) AS p, count(g) / CAST(max(n_gt) AS DOUBLE) AS r FROM (SELECT DISTINCT cr, variant, {item} FROM pred) q LEFT JOIN (SELECT DISTINCT cr, {item}, 1 AS g FROM gt) t USING (cr, {item}) JOIN (SELECT cr, count(DISTINCT {item}) AS n_gt FROM gt GROUP BY cr) s USING (cr) GROUP BY cr, variant)"""


def _prf(spark: SparkSession, d: str, item: str) -> DataFrame:
    x = E.prf(truth(spark, d), predicted(spark, d), ["cr", "variant"], item, ["cr"])
    return x.select("cr", "variant", "tp", "n_pred", "n_gt", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_GT}, {_PRED} {_prf_sql('item', '')}")
def set_prf(spark: SparkSession, d: str) -> DataFrame:
    return _prf(spark, d, "item")


_DUAL = f"dual AS (SELECT a.cr, a.variant, a.f1 AS entity_f1, b.f1 AS file_f1 FROM ({_prf_sql('item', '')}) a JOIN ({_prf_sql('source', '')}) b USING (cr, variant))"


def dual(spark: SparkSession, d: str) -> DataFrame:
    a, b = _prf(spark, d, "item"), _prf(spark, d, "source")
    return a.select("cr", "variant", F.col("f1").alias("entity_f1")).join(b.select("cr", "variant", F.col("f1").alias("file_f1")), ["cr", "variant"])


@query(f"WITH {_GT}, {_PRED}, {_DUAL} SELECT * FROM dual")
def dual_granularity(spark: SparkSession, d: str) -> DataFrame:
    return dual(spark, d)


@query(f"WITH {_GT}, {_PRED}, r AS (SELECT cr, variant, item, row_number() OVER (PARTITION BY cr, variant ORDER BY n_chars DESC, item) AS rank FROM pred), s AS (SELECT cr, count(DISTINCT item) AS n FROM gt GROUP BY cr) SELECT cr, variant, round(count(g) / CAST(max(n) AS DOUBLE), 6) AS r_precision FROM r JOIN s USING (cr) LEFT JOIN (SELECT cr, item, 1 AS g FROM gt) t USING (cr, item) WHERE rank <= n GROUP BY cr, variant")
def r_precision(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = predicted(spark, d)
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("cr", "variant").orderBy(F.desc("n_chars"), "item")))
    g = truth(spark, d).join(p.select("cr", "variant").distinct(), "cr")
    return E.r_precision(g, ranked, ["cr", "variant"], "item", "rank").select("cr", "variant", F.round("r_precision", 6).alias("r_precision"))


@query("SELECT event_type AS variant, round(avg(CASE WHEN value >= 0 THEN value END), 4) AS value, round(quantile_cont(CASE WHEN value >= 0 THEN value END, 0.5), 6) AS median_value, sum(CASE WHEN value >= 0 THEN 1 ELSE 0 END)::BIGINT AS n_ok, sum(CASE WHEN value >= 0 THEN 0 ELSE 1 END)::BIGINT AS n_error FROM events GROUP BY event_type")
def macro_avg(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("variant"), "value", F.when(F.col("value") >= 0, "ok").otherwise("error").alias("status"))
    return E.macro(e, "variant", ["value"], ["value"]).select("variant", F.round("value", 4).alias("value"), F.round("median_value", 6).alias("median_value"), "n_ok", "n_error")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return E.latency(fx.table(spark, d, "events"), "event_type", "value").select("event_type", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "n")


@query(f"WITH {_GT}, {_PRED}, {_DUAL} SELECT cr, {', '.join(f'max(CASE WHEN variant = {chr(39)}{v}{chr(39)} THEN entity_f1 END) AS {chr(34)}{v}{chr(34)}' for v in VARIANTS)} FROM dual GROUP BY cr")
def pivot_variants(spark: SparkSession, d: str) -> DataFrame:
    return E.pivot(dual(spark, d), "cr", "variant", "entity_f1", VARIANTS)


@query("WITH a AS (SELECT c_nationkey AS k, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'), b AS (SELECT c_nationkey AS k, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O') SELECT k, round(sum(CAST(sign(a.v - b.v) AS DOUBLE)) / CAST(count(*) AS DOUBLE), 6) AS delta FROM a JOIN b USING (k) GROUP BY k")
def cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    return E.cliffs_delta(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["k"], "v").where("delta is not null").select("k", F.round("delta", 6).alias("delta"))


_PAIRS = "pairs AS (SELECT o_orderpriority AS k, round(o_totalprice / CAST(1000 AS DOUBLE)) AS a, round(c_acctbal / CAST(50 AS DOUBLE)) AS b FROM orders JOIN customer ON c_custkey = o_custkey)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.select(F.col("o_orderpriority").alias("k"), F.round(F.col("o_totalprice") / 1000.0).alias("a"), F.round(F.col("c_acctbal") / 50.0).alias("b"))


@query(f"WITH {_PAIRS}, d AS (SELECT k, a - b AS d FROM pairs WHERE a <> b), r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / CAST(2 AS DOUBLE) AS r FROM d) SELECT k, count(*) AS n, coalesce(sum(CASE WHEN d > 0 THEN r END), 0) AS w_plus FROM r GROUP BY k")
def wilcoxon_stat(spark: SparkSession, d: str) -> DataFrame:
    return E.signed_ranks(_pairs(spark, d), ["k"], "a", "b").select("k", "n", "w_plus")


@query(f"WITH {_PAIRS} SELECT k, quantile_cont(a - b, 0.5) AS median_difference FROM pairs GROUP BY k")
def median_difference(spark: SparkSession, d: str) -> DataFrame:
    return E.median_difference(_pairs(spark, d), ["k"], "a", "b")


@query()
def wilcoxon_test(spark: SparkSession, d: str) -> DataFrame:
    """Statistics from Spark, p from the driver: one row for each priority."""
    rows = E.signed_ranks(_pairs(spark, d), ["k"], "a", "b").collect()
    return spark.createDataFrame(E.tested(rows), "k string, n long, w_plus double, p double")


@query("WITH g AS (SELECT lang AS cr, source || '::' || doc_id AS node, source AS f FROM documents JOIN labels USING (doc_id) WHERE quality = 1), p AS (SELECT lang AS cr, source || '::' || doc_id AS node, source AS f FROM documents WHERE n_chars % 5 = 0) SELECT cr, node, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.cr = g.cr AND p.node = g.node) THEN 'EXACT' WHEN EXISTS (SELECT 1 FROM p WHERE p.cr = g.cr AND p.f = g.f) THEN 'FILE_ONLY' ELSE 'NO_FILE' END AS match FROM g")
def gt_match_class(spark: SparkSession, d: str) -> DataFrame:
    node = F.concat("source", F.lit("::"), F.col("doc_id").cast("string")).alias("node")
    x = fx.table(spark, d, "documents")
    return E.match_class(x.join(fx.table(spark, d, "labels").where("quality = 1"), "doc_id").select(F.col("lang").alias("cr"), node), x.where("n_chars % 5 = 0").select(F.col("lang").alias("cr"), node))


@query("WITH r AS (SELECT source AS cr, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT cr, CASE WHEN rank IS NULL OR rank > 40 THEN 'not in pool' WHEN rank <= 15 THEN '1-15' WHEN rank <= 25 THEN '16-25' WHEN rank <= 30 THEN '26-30' ELSE '>30' END AS bucket FROM labels LEFT JOIN r USING (doc_id) WHERE quality = 1) SELECT bucket, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM b), 6) AS pct FROM b GROUP BY bucket")
def k_buckets(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from ..operators.audit import counts

    r = fx.table(spark, d, "documents").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank")).where("rank <= 40")
    b = fx.table(spark, d, "labels").where("quality = 1").join(r, "doc_id", "left").select(X.rank_bucket(F.col("rank")).alias("bucket"))
    return counts(b, "bucket").select("bucket", "n", F.round("pct", 6).alias("pct"))


@query("SELECT lang AS variant, count(*) AS retrieved, count(*) FILTER (WHERE n_chars >= 200) AS gated, count(*) FILTER (WHERE n_chars >= 200 AND quality = 1) AS validated, count(*) FILTER (WHERE n_chars >= 200 AND quality = 1 AND toxic = 0) AS reported FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def attrition(spark: SparkSession, d: str) -> DataFrame:
    x = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id", "left")
    gated = F.col("n_chars") >= 200
    valid = gated & (F.col("quality") == 1)
    return x.groupBy(F.col("lang").alias("variant")).agg(F.count("*").alias("retrieved"), F.count_if(gated).alias("gated"), F.count_if(F.coalesce(valid, F.lit(False))).alias("validated"), F.count_if(F.coalesce(valid & (F.col("toxic") == 0), F.lit(False))).alias("reported"))


@query("(SELECT doc_id, 'left' AS side FROM documents WHERE n_chars % 3 = 0 AND n_chars % 2 <> 0) UNION ALL (SELECT doc_id, 'right' FROM documents WHERE n_chars % 3 <> 0 AND n_chars % 2 = 0)")
def determinism_diff(spark: SparkSession, d: str) -> DataFrame:
    x = fx.table(spark, d, "documents")
    return E.changes(x.where("n_chars % 3 = 0").select("doc_id"), x.where("n_chars % 2 = 0").select("doc_id"))


@query("SELECT count(DISTINCT props) AS n_hashes, count(DISTINCT props) = 1 AS consistent FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-15'")
def config_consistency(spark: SparkSession, d: str) -> DataFrame:
    return E.one_config(fx.table(spark, d, "events"), "props", "ts", F.lit("2024-01-15").cast("timestamp_ntz"))


@query("SELECT source AS cr, count(*) FILTER (WHERE regexp_full_match(split_part(regexp_replace(text, '[^A-Za-z_0-9]', ' ', 'g'), ' ', 1), '[A-Za-z_][A-Za-z0-9_]*')) AS ascii_names FROM documents GROUP BY source")
def crosslingual_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.split_part(F.regexp_replace("text", "[^A-Za-z_0-9]", " "), F.lit(" "), F.lit(1))
    return fx.table(spark, d, "documents").groupBy(F.col("source").alias("cr")).agg(F.count_if(X.is_identifier(name)).alias("ascii_names"))


# Maintenance: yesterday's snapshot lacks ids that 17 divides, has other contents where 13 does, and has files that are gone.
_SNAP = "new AS (SELECT 'f' || doc_id AS file_path, sha256(text) AS content_hash FROM documents), old AS (SELECT 'f' || doc_id AS file_path, CASE WHEN doc_id % 13 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT 'gone' || nullif(doc_id, -1), sha256(source) FROM documents WHERE doc_id % 19 = 0)"
_DIFF = "diff AS (SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN o.content_hash <> n.content_hash THEN 'changed' ELSE 'same' END AS status FROM new n FULL JOIN old o ON o.file_path = n.file_path)"


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = fx.table(spark, d, "documents")
    name = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("file_path")
    new = x.select(name("f"), X.content_hash(F.col("text")).alias("content_hash"))
    old = x.where("doc_id % 17 <> 0").select(name("f"), F.when(F.col("doc_id") % 13 == 0, X.content_hash(F.concat("text", F.lit("x")))).otherwise(X.content_hash(F.col("text"))).alias("content_hash"))
    return old.union(x.where("doc_id % 19 = 0").select(name("gone"), X.content_hash(F.col("source")))), new


@query(f"WITH {_SNAP}, {_DIFF} SELECT * FROM diff")
def hash_diff(spark: SparkSession, d: str) -> DataFrame:
    return I.hash_diff(*snapshots(spark, d))


@query(f"WITH {_SNAP}, {_DIFF}, work AS (SELECT file_path FROM diff WHERE status IN ('new', 'changed')), dep AS (SELECT 'f' || doc_id AS dependent, 'f' || (doc_id // 2) AS target FROM documents) SELECT DISTINCT dependent AS file_path FROM dep WHERE target IN (SELECT file_path FROM work) AND dependent NOT IN (SELECT file_path FROM work)")
def reverse_deps(spark: SparkSession, d: str) -> DataFrame:
    """Each document depends on the one of half its number."""
    work = hash_diff(spark, d).where(F.col("status").isin("new", "changed")).select("file_path")
    dep = fx.table(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("dependent_file"), F.concat(F.lit("f"), F.expr("doc_id div 2").cast("string")).alias("target_file"))
    return I.reverse_dependents(work, dep)


@query("WITH t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id, value FROM t WHERE r = 1")
def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of their user, clicks upserted into the others"""
    e = fx.table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    return I.upsert(e.where("event_type <> 'click'"), e.where("event_type = 'click'"), ["user_id"], "event_id").select("user_id", "event_id", "value")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def insert_ignore_edges(spark: SparkSession, d: str) -> DataFrame:
    line = fx.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    keys = ["l_partkey", "l_suppkey"]
    return I.insert_ignore(line.where("l_returnflag = 'A'").select(*keys).distinct(), line.where("l_returnflag <> 'A'").select(*keys), keys)




@query("SELECT 'nodes' AS part, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'edges', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'pairs', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'dependencies', count(*) FROM nation WHERE n_regionkey <> 1")
def cascade_purge(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one region's nations, as the symbols of deleted files"""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c, o, n = (fx.table(spark, d, t) for t in ("customer", "orders", "nation"))
    nodes = c.select(key("c", "c_custkey").alias("node_id"), F.lit("Function").alias("node_type"), key("n", "c_nationkey").alias("file_path"))
    edges = o.select(key("o", "o_orderkey").alias("source_id"), key("c", "o_custkey").alias("target_id"), F.lit("CALLS").alias("edge_type"))
    pairs = c.select(key("c", "c_custkey").alias("code_id"), F.lit("d").alias("doc_id"))
    deps = n.select(key("n", "n_nationkey").alias("dependent_file"), key("r", "n_regionkey").alias("target_file"))
    left = I.purge_files(nodes, edges, pairs, deps, n.where("n_regionkey = 1").select(key("n", "n_nationkey").alias("file_path")))
    out = None
    for k, x in left.items():
        one = x.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# Text transforms
@query(r"WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS s FROM pages), r AS (SELECT route, list_filter(string_split(route, '/'), lambda x: x <> '') AS t FROM (VALUES ('/en/{id}'), ('/{lang}/{id}'), ('/de'), ('/{any}')) AS v(route)), m AS (SELECT page_id, route, len(list_filter(t, lambda x: starts_with(x, '{'))) AS wild FROM p JOIN r ON len(s) = len(t) WHERE len(list_filter(range(1, len(t) + 1), lambda i: NOT (starts_with(t[i], '{') OR t[i] = s[i]))) = 0) SELECT page_id, route FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY wild, route) AS rn FROM m) WHERE rn = 1")
def route_match(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "[?#].*$", "")
    urls = fx.table(spark, d, "pages").select("page_id", path.alias("path"))
    routes = spark.createDataFrame([("/en/{id}",), ("/{lang}/{id}",), ("/de",), ("/{any}",)], "route string")
    return T.match_routes(urls, routes, "page_id", "path")


@query("WITH s AS (SELECT * FROM (VALUES ('./a', 'src/lib/a.ts'), ('./b', 'src/lib/b/index.ts'), ('@/app/page', 'src/app/page.tsx')) AS v(spec, target)) SELECT doc_id, 'src/lib/c.ts' AS file_path, spec, target FROM documents, s")
def import_resolve(spark: SparkSession, d: str) -> DataFrame:
    """References between files of a small repository resolved by probing; all documents' sources as importers."""
    files = spark.createDataFrame([("src/lib/a.ts",), ("src/lib/b/index.ts",), ("src/app/page.tsx",)], "file_path string")
    specs = spark.createDataFrame([("./a",), ("./b",), ("@/app/page",), ("react",)], "spec string")
    x = fx.table(spark, d, "documents").select(F.lit("src/lib/c.ts").alias("file_path"), "doc_id").crossJoin(F.broadcast(specs))
    return T.resolve_imports(x, files)


@query("SELECT doc_id, CASE WHEN contains(t, 'non-functional') OR contains(t, 'non-fungsional') OR contains(t, 'kebutuhan non') THEN 'NFR' WHEN contains(t, 'functional requirement') OR contains(t, 'kebutuhan fungsional') OR contains(t, 'use case') THEN 'FR' WHEN contains(t, 'design') OR contains(t, 'architecture') OR contains(t, 'perancangan') OR contains(t, 'desain') OR contains(t, 'arsitektur') THEN 'Design' ELSE 'General' END AS chunk_type FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def chunk_classify(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", X.chunk_type(F.col("text")).alias("chunk_type"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query("WITH p AS (SELECT doc_id, 'src/' || CASE doc_id % 6 WHEN 0 THEN 'app/' WHEN 1 THEN 'components/' WHEN 2 THEN 'lib/' WHEN 3 THEN 'lib/db/models/' WHEN 4 THEN 'types/' ELSE 'lib/test/' END || source || CASE doc_id % 2 WHEN 0 THEN '/route.ts' ELSE '/page.tsx' END AS path FROM documents) SELECT doc_id, path, CASE doc_id % 6 WHEN 0 THEN 'API_ROUTE' WHEN 1 THEN 'UI_COMPONENT' WHEN 2 THEN 'UTILITY' WHEN 3 THEN 'TYPE_DEFINITION' WHEN 4 THEN 'TYPE_DEFINITION' END AS file_class, CASE doc_id % 6 WHEN 0 THEN '/' || regexp_extract(path, 'src/app/(.*)/', 1) END AS route FROM p")
def file_classify(spark: SparkSession, d: str) -> DataFrame:
    where = fx.pick(F.col("doc_id") % 6, ["app/", "components/", "lib/", "lib/db/models/", "types/", "lib/test/"])
    path = F.concat(F.lit("src/"), where, "source", fx.pick(F.col("doc_id") % 2, ["/route.ts", "/page.tsx"]))
    x = fx.table(spark, d, "documents").select("doc_id", path.alias("path"))
    return x.select("doc_id", "path", X.file_class(F.col("path")).alias("file_class"), X.route_path(F.col("path")).alias("route"))


@query()
def md_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: each line that ends a sentence of one word is a heading."""
    head = F.regexp_replace("text", r"(?m)^(\S+)\.$", "## $1")
    return T.chunks(fx.table(spark, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), head.alias("text")))


@query()
def ts_extract(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of generated TypeScript, a file for each page: its title's words as functions that call each other."""
    word = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^A-Za-z]+", "")
    src = F.concat(F.lit("import { api } from './api'\n\n/** Page. */\nexport function fn"), word, F.lit("(id: string): void {\n  const rows = load"), word, F.lit("(id)\n  return rows\n}\n\nexport const load"), word, F.lit(" = (id: string) => api(id)\n"))
    files = fx.table(spark, d, "pages").select(F.concat(F.lit("src/lib/p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), src.alias("content"))
    return T.nodes(files, written).select("node_id", "node_type", "name", "file_path", "signature", "exported", "line_start")
