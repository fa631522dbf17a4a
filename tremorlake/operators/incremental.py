"""Change detection and table maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F


def hash_diff(old: DataFrame, new: DataFrame, key: str = "file_path", value: str = "content_hash") -> DataFrame:
    """(key, status): new, changed, same or deleted, by one full outer join."""
    o, n = old.select(key, F.col(value).alias("_o")), new.select(key, F.col(value).alias("_n"))
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") != F.col("_n"), "changed").otherwise("same")
    return o.join(n, key, "full").select(key, status.alias("status"))


def reverse_dependents(work: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Files that depend on a file to be redone and aren't redone themselves."""
    w = work.select(F.col("file_path").alias("target_file"))
    return dependencies.join(w, "target_file", "left_semi").select(F.col("dependent_file").alias("file_path")).distinct().join(work.select("file_path"), "file_path", "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row of the latest `order`; both sides have that column, and ties go to `rows`."""
    both = table.withColumn("_side", F.lit(0)).unionByName(rows.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_side"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_side")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and the rows of new keys, each once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def replace(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows instead of the table's rows of the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def purge_files(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, dependencies: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables without what belongs to files (file_path): nodes, edges at either end, pairs of their code, dependencies of them.

    External packages go only when no other file's edge needs them.
    """
    gone = nodes.where("node_type <> 'ExternalPackage'").join(files.select("file_path"), "file_path", "left_semi").select("node_id")
    left = edges.join(gone.select(F.col("node_id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    kept = nodes.join(gone, "node_id", "left_anti")
    used = left.select(F.col("target_id").alias("node_id")).distinct()
    packages = kept.where("node_type = 'ExternalPackage'").join(files.select("file_path"), "file_path", "left_semi").join(used, "node_id", "left_anti").select("node_id")
    deps = dependencies.join(files.select(F.col("file_path").alias("dependent_file")), "dependent_file", "left_anti").join(files.select(F.col("file_path").alias("target_file")), "target_file", "left_anti")
    return {"nodes": kept.join(packages, "node_id", "left_anti").select(*nodes.columns), "edges": left.select(*edges.columns), "pairs": pairs.join(gone.select(F.col("node_id").alias("code_id")), "code_id", "left_anti").select(*pairs.columns), "dependencies": deps.select(*dependencies.columns)}


def purge_documents(chunks: DataFrame, pairs: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Chunks of the files and the pairs of these chunks go."""
    gone = chunks.join(files.select(F.col("file_path").alias("source_file")), "source_file", "left_semi").select("doc_id")
    return {"chunks": chunks.join(gone, "doc_id", "left_anti").select(*chunks.columns), "pairs": pairs.join(gone, "doc_id", "left_anti").select(*pairs.columns)}


def drop_outgoing(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose source isn't in these files."""
    own = nodes.join(files.select("file_path"), "file_path", "left_semi").select(F.col("node_id").alias("source_id"))
    return edges.join(own, "source_id", "left_anti").select(*edges.columns)


def drop_dependencies(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """Dependencies of other files than these; those on them stay."""
    return dependencies.join(files.select(F.col("file_path").alias("dependent_file")), "dependent_file", "left_anti").select(*dependencies.columns)


def dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dependent_file, target_file): files whose edges lead to another file, each pair once."""
    at = nodes.where("file_path IS NOT NULL").select("node_id", "file_path")
    x = edges.join(at.select(F.col("node_id").alias("source_id"), F.col("file_path").alias("dependent_file")), "source_id").join(at.select(F.col("node_id").alias("target_id"), F.col("file_path").alias("target_file")), "target_id")
    return x.where("dependent_file <> target_file").select("dependent_file", "target_file").distinct()


def rebuild(stored: dict[str, DataFrame], files: DataFrame, extract: Callable[[DataFrame], DataFrame], link: Callable[[DataFrame, DataFrame], DataFrame], written=lambda df: df) -> dict[str, DataFrame]:
    """The tables hashes, nodes, edges, pairs, dependencies after files (path, file_path, content, content_hash) took the place of what they were made from.

    New and changed files are extracted again, those that depend on them or on
    a deleted one are linked again, whatever a changed or deleted file had is
    purged, and the rest stays. extract gives nodes of files, link the edges of
    files against nodes known of others; pairs of purged nodes go, and the
    matrix is the caller's to fill.
    """
    status = written(hash_diff(stored["hashes"], files.select("file_path", "content_hash")))
    gone = status.where("status IN ('changed', 'deleted')").select("file_path")
    work = status.where("status IN ('new', 'changed')").select("file_path")
    again = reverse_dependents(status.where("status IN ('changed', 'deleted')").select("file_path"), stored["dependencies"]).join(work, "file_path", "left_anti")
    redo = written(again.join(files.select("file_path"), "file_path", "left_semi"))
    left = purge_files(stored["nodes"], drop_outgoing(stored["edges"], stored["nodes"], redo), stored["pairs"], drop_dependencies(stored["dependencies"], redo), gone)
    fresh = written(extract(files.join(work, "file_path", "left_semi")).select(*stored["nodes"].columns))
    nodes = written(left["nodes"].join(fresh.select("node_id"), "node_id", "left_anti").unionByName(fresh))
    todo = files.join(work.unionByName(redo), "file_path", "left_semi")
    edges = written(insert_ignore(left["edges"], link(todo, nodes).select(*stored["edges"].columns), ["source_id", "target_id", "edge_type"]))
    hashes = replace(stored["hashes"].join(gone, "file_path", "left_anti"), files.join(work, "file_path", "left_semi").select("file_path", "content_hash"), "file_path")
    return {"hashes": hashes, "nodes": nodes, "edges": edges, "pairs": left["pairs"], "dependencies": dependencies(edges, nodes)}
