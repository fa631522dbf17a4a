"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df as Parquet below spark.checkpoint.dir, read again: computed once, lineage cut, safe from lost executors. Local sessions without that setting use a temporary folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tremorlake-"))
        base = context.getCheckpointDir().get()
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
