"""Typed dependency graph: degrees, capped propagation from many seeds, collapse, siblings, label propagation.

Nodes are (node_id, node_type, file_path, file_class), edges (source_id, target_id, edge_type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import dims
from ..functions.text import severity, severity_rank


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree, degree) over all edge types"""
    end = lambda c, i: F.struct(F.col(c).alias("node_id"), F.lit(i).alias("i"), F.lit(1 - i).alias("o"))
    ends = edges.select(F.explode(F.array(end("source_id", 0), end("target_id", 1))).alias("e")).select("e.*")
    return ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def hubs(edges: DataFrame, more_than: int = 20) -> DataFrame:
    return degrees(edges).where(F.col("degree") > more_than)


def confidence_tiers(seeds: DataFrame, top: int = 5) -> DataFrame:
    """Seeds (cr, node_id, score) with tier high for the `top` best of each request, by score (missing: 0)."""
    w = Window.partitionBy("cr").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "node_id")
    return seeds.withColumn("rank", F.row_number().over(w)).withColumn("tier", F.when(F.col("rank") <= top, "high").otherwise("low"))


def steps(edges: DataFrame, config: DataFrame) -> DataFrame:
    """(u, nbr, edge_type, ord, max_depth): the neighbours that propagation may follow from u, by the direction of the edge type; repeated edges stay."""
    e = edges.join(F.broadcast(config), "edge_type")  # 14 rows
    u = F.when(F.col("direction") == "forward", F.col("source_id")).otherwise(F.col("target_id"))
    v = F.when(F.col("direction") == "forward", F.col("target_id")).otherwise(F.col("source_id"))
    return e.select(u.alias("u"), v.alias("nbr"), "edge_type", "ord", "max_depth")


def propagate(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, config: DataFrame, hub_degree: int = 20, max_depth: int = 3, written=lambda df: df) -> DataFrame:
    """(node_id, depth, chain, path, seed, severity, is_seed): what changes to the seeds may reach.

    seeds: (node_id, ord, low), and cr where several requests are followed at
    once, each by itself. Breadth first, level by level: an arrival counts
    if its severity is better than all that came to its node before, in the
    order of (parent, edge type, neighbour). Depth is capped by edge type; at
    one for hubs, for calls of low-confidence seeds and for calls of utility
    files. External packages and nodes of more incoming edges than their type
    allows aren't entered. Seeds stay as they are.
    """
    kinds = config.collect()  # 14 rows
    cap = F.create_map(*[F.lit(x) for kv in dims.FAN_IN.items() for x in kv])
    edges = written(edges)
    info = written(nodes.join(degrees(edges), "node_id", "left").select(
        "node_id", (F.coalesce("degree", F.lit(0)) > hub_degree).alias("hub"),
        F.coalesce((F.col("node_type") == dims.NEVER) | ((cap[F.col("node_type")] > 0) & (F.coalesce("in_degree", F.lit(0)) > cap[F.col("node_type")])), F.lit(False)).alias("closed"), F.coalesce(F.col("file_class") == "UTILITY", F.lit(False)).alias("utility"),
    ))
    single = "cr" not in seeds.columns
    seeds = seeds.withColumn("cr", F.lit(0)) if single else seeds
    key = ["cr", "node_id"]
    first = seeds.groupBy(*key).agg(F.min_by("low", "ord").alias("low"), F.min("ord").alias("ord"))
    step = written(steps(edges, config).join(info.where("closed").select(F.col("node_id").alias("nbr")), "nbr", "left_anti"))
    # seq has the seed's place, then edge type and neighbour of each step: it gives the order, and chain and path in the end
    level = first.join(info.select("node_id", "utility", "hub"), "node_id", "left").select(*key, F.col("node_id").alias("seed"), F.coalesce("low", F.lit(False)).alias("low"), F.coalesce("utility", F.lit(False)).alias("utility"), F.array(F.lpad(F.col("ord").cast("string"), 12, "0")).alias("seq"), F.lit(-1).alias("rank"), "hub")
    level = written(level)
    found = level
    for depth in range(max_depth):
        # what a node's degree, edge type and seed allow; nodes that aren't in the graph lead nowhere
        open_ = level.where("hub IS NOT NULL" if not depth else "NOT hub").select("cr", F.col("node_id").alias("u"), "seed", "low", "utility", "seq")
        arrive = open_.join(step.where(F.col("max_depth") > depth), "u")
        if depth:
            arrive = arrive.where((F.col("edge_type") != "CALLS") | ~(F.col("low") | F.col("utility")))
        arrive = arrive.select("cr", F.col("nbr").alias("node_id"), "seed", "low", "utility", F.concat("seq", F.array(F.lpad(F.col("ord").cast("string"), 3, "0"), F.col("nbr"))).alias("seq"), severity_rank(severity(F.array("edge_type"))).alias("rank"))
        # of one severity only the first arrival can be better than all before it, so at most three rows of a node are left
        had = found.groupBy(*key).agg(F.min("rank").alias("had"))
        w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        arrive = arrive.join(had, key, "left").where(F.col("rank") < F.coalesce("had", F.lit(9))).withColumn("run", F.min("rank").over(w)).where(F.col("rank") < F.coalesce("run", F.lit(9))).drop("had", "run")
        level = written(arrive.join(info.select("node_id", "hub"), "node_id", "left").select(*level.columns))
        found = found.unionByName(level)
        if depth + 1 < max_depth and not level.limit(1).count():
            break
    last = found.groupBy(*key).agg(F.min_by(F.struct("seq", "seed"), "rank").alias("t"))
    name = F.create_map(*[F.lit(x) for r in kinds for x in (f"{r['ord']:03d}", r["edge_type"])])
    chain = F.transform(F.filter("t.seq", lambda _, i: i % 2 == 1), lambda x: name[x])
    path = F.concat(F.array("t.seed"), F.filter("t.seq", lambda _, i: (i > 0) & (i % 2 == 0)))
    out = last.select(*(["node_id"] if single else key), ((F.size("t.seq") - 1) / 2).cast("int").alias("depth"), chain.alias("chain"), path.alias("path"), F.col("t.seed").alias("seed"))
    return out.withColumn("severity", severity(F.col("chain"))).withColumn("is_seed", F.col("depth") == 0)


def _key(df: DataFrame) -> list[str]:
    """cr, where rows are of several requests, each followed by itself."""
    return ["cr"] if "cr" in df.columns else []


def collapse_fields(cis: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cis (cr?, node_id, is_seed, …) without propagated interface fields that only containment ties to a parent in it; parents list them as collapsed_children."""
    key = _key(cis)
    fields = cis.where(~F.col("is_seed")).join(nodes.where("node_type = 'InterfaceField'").select("node_id"), "node_id", "left_semi").select(*key, "node_id")
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("n"), "edge_type"), F.struct(F.col("target_id").alias("n"), "edge_type"))).alias("e")).select("e.*")
    only = ends.join(fields.select(F.col("node_id").alias("n")).distinct(), "n", "left_semi").groupBy("n").agg(F.min("edge_type").alias("a"), F.max("edge_type").alias("b")).where("a = 'CONTAINS' AND b = 'CONTAINS'").select(F.col("n").alias("child"))
    owners = nodes.where(F.col("node_type").isin("Interface", "Enum", "Class", "File")).select(F.col("node_id").alias("parent"))
    link = edges.where("edge_type = 'CONTAINS'").select(F.col("source_id").alias("parent"), F.col("target_id").alias("child")).join(only, "child", "left_semi").join(owners, "parent", "left_semi")
    fold = fields.withColumnRenamed("node_id", "child").join(link, "child").join(cis.select(*key, F.col("node_id").alias("parent")), [*key, "parent"], "left_semi").select(*key, "parent", "child").distinct()
    kids = fold.groupBy(*key, F.col("parent").alias("node_id")).agg(F.array_sort(F.collect_list("child")).alias("collapsed_children"))
    rest = cis.join(fold.select(*key, F.col("child").alias("node_id")).distinct(), [*key, "node_id"], "left_anti")
    return rest.join(kids, [*key, "node_id"], "left").withColumn("collapsed_children", F.coalesce("collapsed_children", F.array().cast("array<string>")))


SIBLING_TYPES = ("Class", "Enum", "Function", "Interface", "Method", "TypeAlias", "Variable")


def siblings(cis: DataFrame, nodes: DataFrame, per_file: int = 12, types: tuple[str, ...] = SIBLING_TYPES, anchors: DataFrame | None = None) -> DataFrame:
    """(cr?, file_path, node_id, anchor, rank): other symbols of the files that hold an anchor (a member of cis, where none are given), up to per_file of each; anchor is the file's least."""
    key = _key(cis)
    anchor = (cis if anchors is None else anchors).join(nodes, "node_id").where(~F.col("node_type").isin("File", "ExternalPackage") & F.col("file_path").isNotNull()).groupBy(*key, "file_path").agg(F.min("node_id").alias("anchor"))
    other = nodes.where(F.col("node_type").isin(*types)).select("file_path", "node_id").join(anchor, "file_path").join(cis.select(*key, "node_id"), [*key, "node_id"], "left_anti")
    w = Window.partitionBy(*key, "file_path").orderBy("node_id")
    return other.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_file)


def admit(found: DataFrame, per_file: int = 4, per_cr: int = 0) -> DataFrame:
    """Siblings (cr, file_path, node_id, rank) within the caps; 0 is no cap. The cap of a request needs its cr."""
    if per_file:
        w = Window.partitionBy(*_key(found), "file_path").orderBy("rank", "node_id")
        found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_file).drop("_n")
    if per_cr:
        w = Window.partitionBy("cr").orderBy("rank", "file_path", "node_id")
        found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_cr).drop("_n")
    return found


def combine(seeds: DataFrame, propagated: DataFrame) -> DataFrame:
    """Seeds override what was propagated to them."""
    key = [*_key(seeds), "node_id"]
    return seeds.unionByName(propagated.join(seeds.select(*key), key, "left_anti"))


def undirected(edges: DataFrame, config: DataFrame) -> DataFrame:
    """(a, b, w): every edge both ways, by its type's weight."""
    e = edges.join(F.broadcast(config.where("weight > 0")), "edge_type")
    return e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("weight").alias("w")).unionByName(e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.col("weight").alias("w")))


def label_propagation(pool: DataFrame, edges: DataFrame, config: DataFrame, top: int = 5, hops: int = 2, decay: float = 0.5, written=lambda df: df) -> DataFrame:
    """(cr?, node_id, graph_score): mass of the `top` best of pool (cr?, node_id, score), after `hops` hops, the seeds' own mass taken off."""
    key = _key(pool)
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    if key:
        seed = pool.withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "node_id"))).where(F.col("_n") <= top)
    else:
        seed = pool.orderBy(F.desc("score"), "node_id").limit(top)
    seed = seed.select(*key, "node_id", F.greatest("score", F.lit(0.0)).alias("m")).withColumn("t", F.sum("m").over(w))
    now = seed.select(*key, "node_id", F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(F.col("m")).alias("m"))
    link, parts, weight = undirected(edges, config), None, 1.0
    for hop in range(hops):
        weight = weight * decay if hop else weight
        now = written(now.join(link, F.col("node_id") == F.col("a")).groupBy(*key, "b").agg(F.sum(F.col("m") * F.col("w")).alias("m")).select(*key, F.col("b").alias("node_id"), "m"))
        part = now.select(*key, "node_id", (F.col("m") * weight).alias("m"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*key, "node_id").agg(F.greatest(F.sum("m"), F.lit(0.0)).alias("graph_score"))


def _span(a: str, b: str):
    return F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(F.lit(1.0))


def blend(pool: DataFrame, graph: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Pool (cr?, node_id, score) with blended = alpha · scaled score + (1 - alpha) · scaled graph score; each request by itself."""
    key = _key(pool)
    x = pool.join(graph, [*key, "node_id"], "left").withColumn("g", F.coalesce("graph_score", F.lit(0.0))).withColumn("c", F.greatest("score", F.lit(0.0)))
    ends = x.groupBy(*key).agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    x = x.join(ends, key) if key else x.crossJoin(F.broadcast(ends))  # without requests one row
    cn, gn = (F.col("c") - F.col("c0")) / _span("c0", "c1"), (F.col("g") - F.col("g0")) / _span("g0", "g1")
    return x.withColumn("blended", F.lit(alpha) * cn + F.lit(1 - alpha) * gn).drop("c0", "c1", "g0", "g1", "c")


def discovered(pool: DataFrame, graph: DataFrame, nodes: DataFrame, blended: DataFrame, top: int = 10, least: float = 0.1) -> DataFrame:
    """(cr?, node_id, score, rrf): the `top` best code nodes outside the pool by graph score, of which those of scaled score `least` or more enter at the pool's upper median, and half of it as rrf."""
    key = _key(pool)
    code = nodes.where(F.col("node_type") != dims.NEVER).select("node_id")
    new = graph.join(code, "node_id", "left_semi").join(pool.select(*key, "node_id"), [*key, "node_id"], "left_anti")
    if key:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("graph_score"), "node_id"))).where(F.col("_n") <= top).drop("_n")
    else:
        new = new.orderBy(F.desc("graph_score"), "node_id").limit(top)
    ends = blended.groupBy(*key).agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.expr("sort_array(collect_list(blended))[int(count(*) / 2)]").alias("mid"))  # a pool has 200 members at most
    new = new.join(ends, key) if key else new.crossJoin(F.broadcast(ends))
    gn = (F.col("graph_score") - F.col("g0")) / _span("g0", "g1")
    return new.where(gn >= least).select(*key, "node_id", F.col("mid").alias("score"), (F.col("mid") / 2).alias("rrf"))
