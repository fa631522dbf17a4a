"""Queries of lexical and vector retrieval, fusion, rescoring and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dims, text as X
from ..operators import lexical, rescoring as R, vectors as V
from . import fixtures as fx
from .registry import query
from .store import written

_RRF = dims.values([(c, p, w) for c, row in dims.RRF.items() for p, w in zip(dims.RRF_PATHS, row)], "rrfw", "change_type, path, weight")


def doc_scores(spark: SparkSession, d: str) -> DataFrame:
    s = lexical.bm25(lexical.lexicon(fx.docs(spark, d), "id", "text", written), fx.requests(spark, d), "cr", "text", written=written)
    return s.select(F.col("qid").alias("cr"), "id", F.round("score", 6).alias("score"))


def code_scores(spark: SparkSession, d: str) -> DataFrame:
    s = lexical.bm25(lexical.lexicon(fx.codes(spark, d), "id", "text", written), fx.requests(spark, d), "cr", "text", written=written)
    return s.select(F.col("qid").alias("cr"), "id", F.round("score", 6).alias("score"))


DOC = f"WITH {fx.SQL_DOCS}, {fx.SQL_REQ}, {fx.sql_bm25('bd', 'docs')}"
BOTH = f"WITH {fx.SQL_DOCS}, {fx.SQL_CODES}, {fx.SQL_REQ}, {fx.sql_bm25('bd', 'docs')}, {fx.sql_bm25('bc', 'codes')}"
_TOP = "row_number() OVER (PARTITION BY cr ORDER BY score DESC, id)"


@query(f"WITH {fx.SQL_DOCS} SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({fx.sql_tokens('text')}) AS term FROM docs) GROUP BY id, term")
def tok_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.terms(fx.docs(spark, d), "id", "text").drop("dl")


@query(f"{DOC} SELECT term, df, round(idf, 6) AS idf FROM bd_i")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.docs(spark, d)
    return lexical.idf(lexical.terms(docs, "id", "text"), docs.agg(F.count("*").alias("n")), written=written).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"{DOC} SELECT * FROM bd")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return doc_scores(spark, d)


@query(f"{DOC} SELECT cr, id, score, rank FROM (SELECT cr, bd.id, score, row_number() OVER (PARTITION BY cr ORDER BY score DESC, bd.id) AS rank FROM bd JOIN docs USING (id) WHERE score > 0 AND chunk_type IN ('FR', 'Design')) WHERE rank <= 30")
def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _doc_top(spark, d, doc_scores(spark, d))


@query(f"{DOC} SELECT id, max(score) AS score FROM bd GROUP BY id")
def bm25_maxmerge(spark: SparkSession, d: str) -> DataFrame:
    return lexical.max_merge(doc_scores(spark, d), ["id"])


@query(f"{BOTH} SELECT cr, id, score, rank FROM (SELECT *, {_TOP} AS rank FROM bc WHERE score > 0) WHERE rank <= 30")
def bm25_code_topk(spark: SparkSession, d: str) -> DataFrame:
    return _code_top(code_scores(spark, d))


@query(f"""WITH {fx.SQL_UNIT} SELECT qid, id, score, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_inner_product(a.v, b.v), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 6) DESC, b.vec_id) AS rank FROM unit a JOIN unit b ON a.vec_id <> b.vec_id) WHERE rank <= 10""")
def cos_knn(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    return V.knn(e, e, 10, "vec_id", "embedding", "vec_id", "embedding").select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {fx.SQL_UNIT} SELECT qid, id, score, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_inner_product(a.v, b.v), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 6) DESC, b.vec_id) AS rank FROM unit a JOIN unit b ON a.vec_id <> b.vec_id WHERE b.label IN (1, 2, 3)) WHERE rank <= 10""")
def cos_knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    return V.knn(e, e.where(F.col("label").isin(1, 2, 3)), 10, "vec_id", "embedding", "vec_id", "embedding").select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {fx.SQL_UNIT} SELECT label, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM (SELECT a.label, b.vec_id AS id, max(round(list_inner_product(a.v, b.v), 6)) AS score FROM unit a JOIN unit b ON a.vec_id <> b.vec_id GROUP BY a.label, b.vec_id)) WHERE rank <= 30""")
def cos_maxmerge(spark: SparkSession, d: str) -> DataFrame:
    """Several queries, one for each vector of a label, merged to one list of the label."""
    e = fx.table(spark, d, "embeddings")
    s = V.merged(e, e, 30, "vec_id", "embedding", "label", "vec_id", "embedding").select(F.col("l").alias("label"), F.col("r").alias("id"), "score")
    return lexical.top_k(s, 30, ["label"]).select("label", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {fx.SQL_MATRIX} SELECT * FROM matrix")
def sim_matrix_dual_topk(spark: SparkSession, d: str) -> DataFrame:
    return fx.matrix(spark, d)


@query(f"""WITH {fx.SQL_MATRIX} SELECT node_id, collection, partner, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, partner) AS rank FROM (SELECT code_id AS node_id, 'code' AS collection, doc_id AS partner, score FROM matrix UNION ALL SELECT doc_id, 'doc', code_id, score FROM matrix)) WHERE rank <= 3""")
def backlinks_both_dirs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reports import backlinks

    ids = fx.code_vectors(spark, d).select(F.col("code_id").alias("node_id"), F.lit("code").alias("collection")).union(fx.doc_vectors(spark, d).select("doc_id", F.lit("doc")))
    return backlinks(ids, fx.matrix(spark, d)).select("node_id", "collection", "partner", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {fx.SQL_MATRIX} SELECT doc_id, code_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code_id) AS rank FROM matrix) WHERE rank <= 3")
def doc_resolution(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(fx.doc_vectors(spark, d).select("doc_id"), fx.matrix(spark, d), 3).select("doc_id", "code_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {fx.SQL_MATRIX} SELECT doc_id, code_id, true AS low FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code_id) AS rank FROM matrix) WHERE rank <= 1")
def blind_seeds(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(fx.doc_vectors(spark, d).select("doc_id"), fx.matrix(spark, d), 1).select("doc_id", "code_id", F.lit(True).alias("low"))


_QUOTA = "SELECT cr, {layer}, id, {score} AS score, row_number() OVER (PARTITION BY cr, {layer} ORDER BY {score} DESC, id) AS r"


@query(f"""{BOTH}, l AS (SELECT cr, coalesce(file_class, 'None') AS layer, id, score FROM bc JOIN codes USING (id) WHERE score > 0),
c AS (SELECT cr, layer, id, score / (score + CAST(1 AS DOUBLE)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cr, layer ORDER BY score DESC, id) AS r FROM l) WHERE r <= 12)
SELECT cr, id, round(max(score), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cr, layer ORDER BY score DESC, id) AS r FROM c) WHERE r <= 12 GROUP BY cr, id""")
def bm25_layer_quota(spark: SparkSession, d: str) -> DataFrame:
    """The lexical side alone; quota_both has the dense one too."""
    return _quota(spark, d, code_scores(spark, d))


def _quota(spark: SparkSession, d: str, scores: DataFrame) -> DataFrame:
    layer = fx.codes(spark, d).select("id", F.coalesce("file_class", F.lit("None")).alias("layer"))
    s = scores.join(layer, "id")
    return lexical.layer_quota(s.limit(0), s, ["cr"], "layer").select("cr", "id", F.round("score", 6).alias("score"))


@query(f"""{BOTH}, l AS (SELECT cr, coalesce(file_class, 'None') AS layer, id, score FROM bc JOIN codes USING (id) WHERE score > 0),
e AS (SELECT cr, coalesce(file_class, 'None') AS layer, id, round(CAST(len(list_intersect(list_distinct({fx.sql_tokens('req.text')}), list_distinct({fx.sql_tokens('name')}))) AS DOUBLE) / 10, 6) AS score FROM req, codes),
c AS (SELECT cr, layer, id, score FROM (SELECT *, row_number() OVER (PARTITION BY cr, layer ORDER BY score DESC, id) AS r FROM e) WHERE r <= 12
 UNION ALL SELECT cr, layer, id, score / (score + CAST(1 AS DOUBLE)) FROM (SELECT *, row_number() OVER (PARTITION BY cr, layer ORDER BY score DESC, id) AS r FROM l) WHERE r <= 12),
m AS (SELECT cr, layer, id, max(score) AS score FROM c GROUP BY cr, layer, id)
SELECT cr, id, round(max(score), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cr, layer ORDER BY score DESC, id) AS r FROM m) WHERE r <= 12 GROUP BY cr, id""")
def quota_both(spark: SparkSession, d: str) -> DataFrame:
    """Layer quotas over both kinds of scores; shared terms of the names stand for cosines."""
    layer = F.coalesce("file_class", F.lit("None")).alias("layer")
    words = lambda c: F.array_distinct(X.tokenise(F.col(c)))
    codes = fx.codes(spark, d)
    near = fx.requests(spark, d).select("cr", words("text").alias("a")).join(codes.select("id", layer, words("name").alias("b")))
    dense = near.select("cr", "layer", "id", F.round(F.size(F.array_intersect("a", "b")) / F.lit(10.0), 6).alias("score"))
    s = code_scores(spark, d).join(codes.select("id", layer), "id")
    return lexical.layer_quota(dense, s, ["cr"], "layer").select("cr", "id", F.round("score", 6).alias("score"))


def _doc_top(spark: SparkSession, d: str, scores: DataFrame) -> DataFrame:
    s = scores.where("score > 0").join(fx.docs(spark, d).where(F.col("chunk_type").isin("FR", "Design")).select("id"), "id", "left_semi")
    return lexical.top_k(s, 30, ["cr"]).select("cr", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def _code_top(scores: DataFrame) -> DataFrame:
    return lexical.top_k(scores.where("score > 0"), 30, ["cr"]).select("cr", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def lists(spark: SparkSession, d: str, doc: DataFrame, code: DataFrame) -> DataFrame:
    """(cr, change_type, path, id, rank) of the BM25 scores: the lexical lists of both collections, and the codes by layer quota as a third"""
    a = _doc_top(spark, d, doc).select("cr", F.lit("bm25_doc").alias("path"), "id", "rank")
    b = _code_top(code).select("cr", F.lit("bm25_code"), "id", "rank")
    c = lexical.top_k(_quota(spark, d, code), 30, ["cr"]).select("cr", F.lit("layer_quota"), "id", F.col("rank").cast("bigint"))
    return a.union(b).union(c).join(fx.requests(spark, d).select("cr", "change_type"), "cr")


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The BM25 scores of both collections, once for all that a query makes of them."""
    return written(doc_scores(spark, d)), written(code_scores(spark, d))


def fused(spark: SparkSession, d: str, doc: DataFrame, code: DataFrame) -> DataFrame:
    return R.fuse(lists(spark, d, doc, code), dims.rrf_weights(spark)).select("cr", "id", F.round("rrf", 6).alias("rrf"))


LISTS = f"""{BOTH}, l AS (SELECT cr, coalesce(file_class, 'None') AS layer, id, score FROM bc JOIN codes USING (id) WHERE score > 0),
lc AS (SELECT cr, layer, id, score / (score + CAST(1 AS DOUBLE)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cr, layer ORDER BY score DESC, id) AS r FROM l) WHERE r <= 12),
lq AS (SELECT cr, id, round(max(score), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cr, layer ORDER BY score DESC, id) AS r FROM lc) WHERE r <= 12 GROUP BY cr, id),
lists AS (SELECT cr, change_type, path, id, rank FROM (
 SELECT cr, 'bm25_doc' AS path, id, row_number() OVER (PARTITION BY cr ORDER BY score DESC, id) AS rank FROM bd JOIN docs USING (id) WHERE score > 0 AND chunk_type IN ('FR', 'Design')
 UNION ALL SELECT cr, 'bm25_code', id, {_TOP} FROM bc WHERE score > 0 UNION ALL SELECT cr, 'layer_quota', id, {_TOP} FROM lq) JOIN req USING (cr) WHERE rank <= 30),
fused AS (SELECT cr, id, round(sum(coalesce(weight, CAST(1 AS DOUBLE)) / (CAST(60 AS DOUBLE) + rank)), 6) AS rrf FROM lists LEFT JOIN {_RRF} USING (change_type, path) GROUP BY cr, id)"""


@query(f"{LISTS} SELECT cr, id, rrf FROM fused")
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, *scored(spark, d))


@query(f"{LISTS} SELECT cr, id, round(sum(CAST(1 AS DOUBLE) / (CAST(60 AS DOUBLE) + rank)), 6) AS rrf FROM lists GROUP BY cr, id")
def rrf_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(lists(spark, d, *scored(spark, d)), None).select("cr", "id", F.round("rrf", 6).alias("rrf"))


POOL = f"""{LISTS}, pool AS (SELECT f.cr, f.id AS node_id, CASE WHEN c.id IS NOT NULL THEN 'code' ELSE 'doc' END AS collection, c.name, coalesce(c.file_path, t.source_file) AS file_path, c.file_class, t.chunk_type, f.rrf,
  round(coalesce(s.score / (s.score + CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE)), 6) AS raw
  FROM (SELECT *, row_number() OVER (PARTITION BY cr ORDER BY rrf DESC, id) AS rank FROM fused) f LEFT JOIN codes c ON c.id = f.id LEFT JOIN docs t ON t.id = f.id
  LEFT JOIN (SELECT cr, id, max(score) AS score FROM (SELECT * FROM bd UNION ALL SELECT * FROM bc) GROUP BY cr, id) s ON s.cr = f.cr AND s.id = f.id WHERE f.rank <= 200)"""


def pool(spark: SparkSession, d: str) -> DataFrame:
    """The fused pool of each request, cut to 200 and joined with what its members are; raw is the saturated BM25 score."""
    doc, code = scored(spark, d)
    top = R.best(fused(spark, d, doc, code).withColumnRenamed("id", "node_id"), 200, "rrf").drop("rank")
    c = fx.codes(spark, d).select(F.col("id").alias("node_id"), "name", F.col("file_path").alias("_f"), "file_class", F.lit("code").alias("collection"))
    t = fx.docs(spark, d).select(F.col("id").alias("node_id"), F.col("source_file").alias("_g"), "chunk_type")
    s = doc.unionByName(code).groupBy("cr", F.col("id").alias("node_id")).agg(F.max("score").alias("s"))
    j = top.join(c, "node_id", "left").join(t, "node_id", "left").join(s, ["cr", "node_id"], "left")
    raw = F.round(F.coalesce(X.saturate(F.col("s")), F.lit(0.0)), 6)
    return j.select("cr", "node_id", F.coalesce("collection", F.lit("doc")).alias("collection"), "name", F.coalesce("_f", "_g").alias("file_path"), "file_class", "chunk_type", "rrf", raw.alias("raw"))


@query(f"{POOL} SELECT * FROM pool")
def pool_hydrate(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d)


@query(f"{POOL} SELECT cr, node_id, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE raw END, 6) AS score FROM (SELECT *, min(raw) OVER (PARTITION BY cr) AS lo, max(raw) OVER (PARTITION BY cr) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY cr ORDER BY raw DESC, node_id) AS rank FROM pool) WHERE rank <= 15)")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    top = R.best(pool(spark, d), 15, "raw").withColumn("score", F.col("raw"))
    return R.scale(top).select("cr", "node_id", F.round("score", 6).alias("score"))


@query(f"{POOL} SELECT cr, node_id, raw FROM pool WHERE raw >= CAST(0.9 AS DOUBLE)")
def score_floor(spark: SparkSession, d: str) -> DataFrame:
    return R.score_floor(pool(spark, d), 0.9).select("cr", "node_id", "raw")


@query(f"{POOL} SELECT cr, node_id, round(raw + CASE WHEN contains(lower(name), 'thation') OR contains(lower(name), 'ingthe') THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 6) AS score FROM pool")
def negative_filter(spark: SparkSession, d: str) -> DataFrame:
    needles = F.array(*[F.lit(x) for x in ("thation", "ingthe", "tion")])  # the last is too short to count
    return R.negative_filter(pool(spark, d).withColumn("score", F.col("raw")), needles).select("cr", "node_id", F.round("score", 6).alias("score"))


@query(f"{POOL}, kinds AS (SELECT * FROM {fx._COMPAT}) SELECT p.cr, node_id, round(raw * CASE WHEN collection = 'doc' THEN CASE WHEN p.chunk_type = prim THEN CAST(1 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END ELSE coalesce(compat, CAST(0.5 AS DOUBLE)) END, 9) AS score FROM pool p JOIN req USING (cr) LEFT JOIN kinds k ON k.file_class = coalesce(p.file_class, 'None') AND k.chunk_type = prim")
def affinity_rescore(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d).withColumn("score", F.col("raw")).join(F.broadcast(fx.requests(spark, d).select("cr", "primary")), "cr")
    return R.affinity(p, dims.layer_compat(spark)).select("cr", "node_id", F.round("score", 9).alias("score"))


@query(f"{POOL} SELECT cr, node_id FROM (SELECT *, sum(CASE WHEN collection = 'code' THEN 1 ELSE 0 END) OVER (PARTITION BY cr, file_path) AS f, sum(CASE WHEN collection = 'code' THEN 1 ELSE 0 END) OVER (PARTITION BY cr) AS a FROM pool) WHERE collection = 'doc' OR CAST(f AS DOUBLE) / a <= CAST(0.02 AS DOUBLE)")
def density_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.density_gate(pool(spark, d), None, 0.02).select("cr", "node_id")


@query(f"{POOL} SELECT cr, node_id, row_number() OVER (PARTITION BY cr ORDER BY CASE WHEN raw > 0 THEN raw ELSE rrf END DESC, node_id) AS rank FROM pool")
def admitted_order(spark: SparkSession, d: str) -> DataFrame:
    return R.admitted(pool(spark, d)).select("cr", "node_id", F.col("rank").cast("bigint").alias("rank"))


# Pools over the similarity matrix: request k has the vectors of label k, as docs and as codes.
_VPOOL = "vpool AS (SELECT label AS cr, 'd' || vec_id AS node_id, 'doc' AS collection, vec_id FROM embeddings UNION ALL SELECT label, 'c' || vec_id, 'code', vec_id FROM embeddings)"


def vector_pool(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    one = lambda p, c: e.select(F.col("label").alias("cr"), F.concat(F.lit(p), F.col("vec_id").cast("string")).alias("node_id"), F.lit(c).alias("collection"), F.lit(0.5).alias("score"))
    return one("d", "doc").union(one("c", "code"))


@query(f"""WITH {fx.SQL_MATRIX}, {_VPOOL}, t AS (SELECT doc_id, code_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code_id) AS r FROM matrix) WHERE r <= 3),
hit AS (SELECT DISTINCT cr, code_id FROM vpool JOIN t ON node_id = doc_id) SELECT cr, node_id, CASE WHEN code_id IS NOT NULL AND collection = 'code' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score FROM vpool LEFT JOIN hit USING (cr) WHERE false
UNION ALL SELECT v.cr, v.node_id, CASE WHEN h.code_id IS NOT NULL THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END FROM vpool v LEFT JOIN hit h ON h.cr = v.cr AND h.code_id = v.node_id AND v.collection = 'code'""")
def trace_bonus(spark: SparkSession, d: str) -> DataFrame:
    return R.trace_bonus(vector_pool(spark, d), fx.matrix(spark, d)).select("cr", "node_id", F.round("score", 6).alias("score"))


@query(f"""WITH {fx.SQL_MATRIX}, {_VPOOL}, t AS (SELECT doc_id, code_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code_id) AS r FROM matrix) WHERE r = 1),
f AS (SELECT a.cr, doc_id, code_id FROM vpool a JOIN t ON a.node_id = doc_id JOIN vpool b ON b.cr = a.cr AND b.node_id = code_id)
SELECT v.cr, v.node_id, coalesce(m.docs, '') AS merged FROM vpool v LEFT JOIN (SELECT cr, code_id, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM f GROUP BY cr, code_id) m ON m.cr = v.cr AND m.code_id = v.node_id
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cr = v.cr AND f.doc_id = v.node_id)""")
def semantic_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.semantic_dedup(vector_pool(spark, d), fx.matrix(spark, d)).select("cr", "node_id", F.array_join("merged_docs", ",").alias("merged"))


@query(f"""WITH {fx.SQL_MATRIX}, found AS (SELECT label AS cr, 'd' || vec_id AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS doc_rank FROM embeddings), have AS (SELECT label AS cr, 'c' || vec_id AS code_id FROM embeddings),
t AS (SELECT doc_id, code_id, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code_id) AS r FROM matrix WHERE score >= {fx.FLOOR}) WHERE r <= 5),
n AS (SELECT f.cr, t.code_id, min({{'a': f.doc_rank, 'b': f.doc_id, 'c': t.r}}) AS first_at FROM found f JOIN t USING (doc_id) LEFT JOIN have h ON h.cr = f.cr AND h.code_id = t.code_id WHERE h.cr IS NULL GROUP BY f.cr, t.code_id)
SELECT cr, code_id, row_number() OVER (PARTITION BY cr ORDER BY first_at, code_id) + 30 AS rank FROM n""")
def trace_seeding(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = fx.table(spark, d, "embeddings")
    found = e.select(F.col("label").alias("cr"), F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("doc_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("doc_rank"))
    have = e.select(F.col("label").alias("cr"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("code_id"))
    return R.seeding(found, fx.matrix(spark, d), have, 5, fx.FLOOR).select("cr", "code_id", F.col("rank").cast("bigint").alias("rank"))
