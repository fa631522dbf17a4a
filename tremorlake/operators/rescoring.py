"""Bonuses, penalties, scaling and the deterministic gates over candidate pools.

A pool has (cr, node_id, collection, name, file_path, score, raw, …); every operator works on each request (cr) by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import contains_any, tokenise


def fuse(lists: DataFrame, weights: DataFrame | None, k: int = 60) -> DataFrame:
    """(cr, id, rrf) of ranked lists (cr, change_type, path, id, rank from 1): the sum over paths of weight / (k + rank).

    A path without a weight counts 1, an unknown change type as MODIFICATION;
    with weights None every path counts 1.
    """
    if weights is None:
        scored = lists.withColumn("w", F.lit(1.0))
    else:
        known = F.when(F.col("change_type").isin("ADDITION", "DELETION"), F.col("change_type")).otherwise("MODIFICATION")
        scored = lists.withColumn("change_type", known).join(F.broadcast(weights), ["change_type", "path"], "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    return scored.groupBy("cr", "id").agg(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))).alias("rrf"))


def best(pool: DataFrame, k: int, score: str, tie: str = "node_id") -> DataFrame:
    w = Window.partitionBy("cr").orderBy(F.desc(score), tie)
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def trace_bonus(pool: DataFrame, matrix: DataFrame, top: int = 3, bonus: float = 0.1) -> DataFrame:
    """Code candidates among the `top` codes of a doc candidate of their request gain `bonus` once."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "code_id")
    lead = matrix.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("doc_id", "code_id")
    hit = pool.where("collection = 'doc'").select("cr", F.col("node_id").alias("doc_id")).join(lead, "doc_id").select("cr", F.col("code_id").alias("node_id"), F.lit("code").alias("collection")).distinct()
    marked = pool.join(hit.withColumn("_hit", F.lit(True)), ["cr", "node_id", "collection"], "left")
    return marked.withColumn("score", F.col("score") + F.when(F.col("_hit"), F.lit(bonus)).otherwise(F.lit(0.0))).drop("_hit")


def negative_filter(pool: DataFrame, needles: Column, penalty: float = -1.0, least: int = 6) -> DataFrame:
    """Candidates whose name holds a needle of `least` characters or more lose a point."""
    return pool.withColumn("score", F.col("score") + F.when(contains_any(F.col("name"), needles, least), F.lit(penalty)).otherwise(F.lit(0.0)))


def overlap(rows: DataFrame) -> DataFrame:
    """rows (…, query, text) with score: the share of the query's terms that the text has. It stands in for a cross-encoder, which any function of this form may be."""
    return rows.withColumn("score", _shared(_terms(F.col("query")), _terms(F.col("text"))))


def _terms(c: Column) -> Column:
    return F.array_distinct(tokenise(c))


def _shared(q: Column, t: Column) -> Column:
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))


def cross_encode(pool: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Callable[[DataFrame], DataFrame] = overlap, places: int = 6) -> DataFrame:
    """pool (cr, node_id, …) with raw: the largest score of any of the request's queries (cr, q, text); null texts count as empty.

    texts: (node_id, abstraction, snippet), of which the abstraction goes before
    the snippet. All pairs of a request's queries and its candidates are scored
    in one call; a request without queries scores 0. For overlap terms are
    taken once from each text and query, not once a pair.
    """
    body = F.coalesce(F.nullif("abstraction", F.lit("")), "snippet", F.lit(""))
    if scorer is overlap:
        pairs = pool.select("cr", "node_id").join(texts.select("node_id", _terms(body).alias("_t")), "node_id").join(queries.select("cr", _terms(F.col("text")).alias("_q")), "cr")
        scored = pairs.select("cr", "node_id", _shared(F.col("_q"), F.col("_t")).alias("score"))
    else:
        scored = scorer(pool.select("cr", "node_id").join(texts.select("node_id", body.alias("text")), "node_id").join(queries.select("cr", F.col("text").alias("query")), "cr"))
    best_ = scored.groupBy("cr", "node_id").agg(F.max("score").alias("raw"))
    return pool.join(best_, ["cr", "node_id"], "left").withColumn("raw", F.round(F.coalesce("raw", F.lit(0.0)), places))


def scale(pool: DataFrame, score: str = "score") -> DataFrame:
    """Min-max scaling within each request; equal scores stay."""
    w = Window.partitionBy("cr")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return pool.withColumn(score, F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(F.col(score)))


def score_floor(pool: DataFrame, floor: float = -2.0) -> DataFrame:
    return pool.where(F.coalesce("raw", F.lit(0.0)) >= floor)


def semantic_dedup(pool: DataFrame, matrix: DataFrame) -> DataFrame:
    """Docs whose first code is in the request's pool go; the code lists them in merged_docs, and where the pool has texts (title, text) also those, as merged."""
    first = matrix.groupBy("doc_id").agg(F.min_by("code_id", F.struct(-F.col("score"), F.col("code_id"))).alias("code_id"))
    doc = pool.where("collection = 'doc'").select("cr", F.col("node_id").alias("doc_id")).join(first, "doc_id")
    code = pool.where("collection = 'code'").select("cr", F.col("node_id").alias("code_id"))
    folded = doc.join(code, ["cr", "code_id"])
    texts = "text" in pool.columns
    if texts:
        own = pool.where("collection = 'doc'").select("cr", F.col("node_id").alias("doc_id"), F.struct(F.col("node_id").alias("id"), F.col("title"), F.col("text")).alias("_m"))
        folded = folded.join(own, ["cr", "doc_id"])
    listed = [F.array_sort(F.collect_set("doc_id")).alias("merged_docs"), *([F.transform(F.array_sort(F.collect_set("_m")), lambda m: F.struct(m["title"], m["text"])).alias("merged")] if texts else [])]
    merged = folded.groupBy("cr", F.col("code_id").alias("node_id")).agg(*listed).withColumn("collection", F.lit("code"))
    gone = folded.select("cr", F.col("doc_id").alias("node_id"), F.lit("doc").alias("collection")).distinct()
    return pool.join(gone, ["cr", "node_id", "collection"], "left_anti").join(merged, ["cr", "node_id", "collection"], "left").withColumn("merged_docs", F.coalesce("merged_docs", F.array().cast("array<string>")))


def affinity(pool: DataFrame, compat: DataFrame, doc_match: float = 1.0, doc_other: float = 0.7) -> DataFrame:
    """Scores by fit with the request's primary chunk type: docs by equality, code by the compatibility of its class."""
    x = pool.withColumn("_c", F.coalesce("file_class", F.lit("None"))).join(F.broadcast(compat.select(F.col("file_class").alias("_c"), F.col("chunk_type").alias("primary"), "compat")), ["_c", "primary"], "left")
    factor = F.when(F.col("collection") == "doc", F.when(F.col("chunk_type") == F.col("primary"), F.lit(doc_match)).otherwise(F.lit(doc_other))).otherwise(F.coalesce("compat", F.lit(0.5)))
    return x.withColumn("score", F.col("score") * factor).drop("_c", "compat")


def primary_chunk(layers: Column) -> Column:
    return F.when(F.array_contains(layers, "code") | F.array_contains(layers, "requirement"), "FR").when(F.array_contains(layers, "design"), "Design").otherwise("General")


def density_gate(pool: DataFrame, entries: Column | None = None, most: float = 0.5) -> DataFrame:
    """Code of files that hold more than `most` of the request's code goes, unless its name holds an entry point; docs stay."""
    code = F.col("collection") == "code"
    in_file = F.sum(code.cast("int")).over(Window.partitionBy("cr", "file_path"))
    in_all = F.sum(code.cast("int")).over(Window.partitionBy("cr"))
    named = contains_any(F.col("name"), entries) if entries is not None else F.lit(False)
    return pool.withColumn("_dense", code & (in_file / in_all > most) & ~named).where(~F.col("_dense")).drop("_dense")


def gates(pool: DataFrame, matrix: DataFrame, compat: DataFrame, on: tuple[bool, bool, bool] = (True, True, True), floor: float = -2.0, entries: Column | None = None, most: float = 0.5) -> DataFrame:
    """The score floor, semantic dedup and plausibility gates, each where its flag is on."""
    if on[0]:
        pool = score_floor(pool, floor)
    if on[1]:
        pool = semantic_dedup(pool, matrix)
    if on[2]:
        pool = density_gate(affinity(pool, compat), entries, most)
    return pool


def admitted(pool: DataFrame) -> DataFrame:
    """Rank by raw score where it is positive, else by rrf."""
    w = Window.partitionBy("cr").orderBy(F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.col("rrf")).desc(), "node_id")
    return pool.withColumn("rank", F.row_number().over(w))


def resolve(docs: DataFrame, matrix: DataFrame, k: int) -> DataFrame:
    """(cr, doc_id, code_id, score, rank): the k best codes of each doc; docs without one drop out."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "code_id")
    lead = matrix.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return docs.join(lead, "doc_id")


def seeding(found: DataFrame, matrix: DataFrame, present: DataFrame, per_doc: int = 5, floor: float = 0.4, after: int = 30) -> DataFrame:
    """(cr, code_id, rank): codes of retrieved docs (cr, doc_id, doc_rank) that no list of the request has, appended after rank `after`.

    Each doc brings its per_doc best codes of floor or more, those already
    present counted; the first doc that brings a code counts.
    """
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "code_id")
    lead = matrix.where(F.col("score") >= floor).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_doc)
    new = found.join(lead, "doc_id").join(present.select("cr", "code_id").distinct(), ["cr", "code_id"], "left_anti")
    first = new.groupBy("cr", "code_id").agg(F.min(F.struct("doc_rank", "doc_id", "r")).alias("at"))
    order = Window.partitionBy("cr").orderBy("at", "code_id")
    return first.select("cr", "code_id", (F.row_number().over(order) + after).alias("rank"))


def merge_seeds(direct: DataFrame, validated: DataFrame) -> DataFrame:
    """(cr, node_id, ord): direct seeds first, then validated ones, each once at its first place."""
    both = direct.select("cr", "node_id", F.struct(F.lit(0).alias("a"), F.col("ord")).alias("at")).unionByName(validated.select("cr", "node_id", F.struct(F.lit(1).alias("a"), F.col("ord")).alias("at")))
    first = both.groupBy("cr", "node_id").agg(F.min("at").alias("at"))
    return first.select("cr", "node_id", F.row_number().over(Window.partitionBy("cr").orderBy("at", "node_id")).alias("ord"))
