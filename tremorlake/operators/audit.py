"""Index-quality aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import percent


def counts(rows: DataFrame, by: str) -> DataFrame:
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.where(~F.col("node_type").isin("ExternalPackage", "InterfaceField")).agg(F.count("*").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(n).withColumn("density", F.when(F.col("nodes") == 0, F.lit(0.0)).otherwise(F.col("edges") / F.col("nodes")))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at neither end of an edge."""
    return nodes.join(endpoints(edges), "node_id", "left_anti")


def ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, kind): sinks are only targets, sources only sources."""
    s, t = edges.select(F.col("source_id").alias("node_id")).distinct(), edges.select(F.col("target_id").alias("node_id")).distinct()
    kind = lambda a, b, k: nodes.select("node_id").join(a, "node_id", "left_semi").join(b, "node_id", "left_anti").withColumn("kind", F.lit(k))
    return kind(t, s, "sink").unionByName(kind(s, t, "source"))


def top_degree(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of most edges; a self-loop counts once in total. One pass over the edges instead of an OR join."""
    e = edges.select(F.explode(F.when(F.col("source_id") == F.col("target_id"), F.array(F.struct(F.col("source_id").alias("node_id"), F.lit(1).alias("i"), F.lit(1).alias("o")))).otherwise(F.array(F.struct(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))))).alias("x")).select("x.*")
    d = e.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total"))
    return nodes.select("node_id", "node_type").join(d, "node_id").orderBy(F.desc("total"), "node_id").limit(k)


def distribution(rows: DataFrame, value: str) -> DataFrame:
    x = F.col(value)
    return rows.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stdev"))


def histogram(rows: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """(bin, n) of equal widths, the last one closed; one bin where all are equal."""
    lo_hi = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(lo_hi)).groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def stranded(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(pairs.select("doc_id").distinct(), "doc_id", "left_anti")


def per_doc(pairs: DataFrame) -> DataFrame:
    return distribution(pairs.groupBy("doc_id").agg(F.count("*").alias("n")), "n")


def broken_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(constraint, violations) of a foreign key; null keys don't count."""
    bad = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def duplicate_keys(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def outside(rows: DataFrame, column: str, allowed: list[str], name: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def aligned(stored: DataFrame, expected: DataFrame) -> DataFrame:
    return stored.agg(F.count("*").alias("stored")).crossJoin(expected.agg(F.count("*").alias("expected"))).withColumn("aligned", F.col("stored") == F.col("expected"))


def benchmark_hits(pairs: DataFrame, names: DataFrame, words: dict[str, list[str]], k: int = 3) -> DataFrame:
    """(doc_id, top1, topk): whether the names of a doc's first and first k codes hold a word expected of it."""
    from ..functions.text import contains_any
    from .vectors import partners

    p = partners(pairs, "doc_id", "code_id", k).join(names.select(F.col("node_id").alias("code_id"), "name"), "code_id")
    hit = F.lit(False)
    for doc, need in words.items():
        hit = F.when(F.col("doc_id") == doc, contains_any(F.col("name"), need)).otherwise(hit)
    return p.withColumn("hit", hit).groupBy("doc_id").agg(F.max((F.col("rank") == 1) & F.col("hit")).alias("top1"), F.max("hit").alias("topk"))
