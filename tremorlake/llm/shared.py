"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, as in tests, a local folder is set and used; on a cluster that fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tremorlake-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts lineage and outlives executors."""
    path = folder(df.sparkSession)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        drop(t.sparkSession, t._written)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let_go(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what is written by now."""
    import gc

    spark.range(1).count()  # the listeners hold the last execution, and so its shuffles, until the next one
    gc.collect()
    spark.sparkContext._jvm.System.gc()
