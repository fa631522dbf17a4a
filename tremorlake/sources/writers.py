"""Writers of tables, reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replaces only the partitions that df has; without partitions the whole table. df must not read from path."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """A table whose rows are bucketed and sorted by keys, so that joins and lookups by them need no shuffle."""
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(name)


def vectors(df: DataFrame, path: str, space: str = "cosine") -> None:
    """A collection of vectors, with the space that its scores are of beside it."""
    table(df, f"{path}/rows")
    df.sparkSession.createDataFrame([(space,)], "space string").write.mode("overwrite").parquet(f"{path}/space")


def metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def reports(df: DataFrame, path: str) -> None:
    """One JSON document a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def metadata(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """The (key, value) table with these values put in."""
    new = df.sparkSession.createDataFrame(list(values.items()), "key string, value string")
    return df.join(new.select("key"), "key", "left_anti").unionByName(new)


def audit_report(parts: dict[str, DataFrame], title: str = "Audit") -> str:
    """A Markdown report with a section for each named summary."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown(df)}" for name, df in parts.items())


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A summary of up to `most` rows as a Markdown table; for aggregates, which are small."""
    rows = df.limit(most).collect()
    show = lambda x: "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"
