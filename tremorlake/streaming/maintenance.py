"""Incremental maintenance over a stream of file versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import hash_diff


def changed_files(stream: DataFrame, state_path: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls handle with the new and changed files (file_path, content_hash, version, status) of each micro-batch.

    The state is a Parquet table of the latest hash of each file, written to a
    new folder by batch, so a batch that runs again reads what it read before.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        latest = df.groupBy("file_path").agg(F.max_by("content_hash", "version").alias("content_hash"), F.max("version").alias("version"))
        schema = "file_path string, content_hash string"
        old = spark.read.schema(schema).parquet(f"{state_path}/{number - 1}") if number else spark.createDataFrame([], schema)
        diff = hash_diff(old, latest.select("file_path", "content_hash")).where(F.col("status").isin("new", "changed"))
        handle(latest.join(diff, "file_path"), number)
        kept = old.join(latest.select("file_path"), "file_path", "left_anti").unionByName(latest.select("file_path", "content_hash"))
        kept.write.mode("overwrite").parquet(f"{state_path}/{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by event type and window; events later than `late` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select("window.start", "window.end", "event_type", "n", "mean_value")
