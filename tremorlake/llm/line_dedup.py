"""Line dedup: levelled sorted runs of line hashes, compacted periodically."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from .shared import folder, written

HASH = ["h1", "h2"]


class Runs:
    """A store of line hashes: runs sorted by hash and bucketed by it, so that no join shuffles them again.

    Level 0 has a run for each batch. When a level has `fanout` runs they are
    merged into one of the next level, so n batches leave O(log n) runs and
    each hash is rewritten O(log n) times.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def new(self, first: DataFrame) -> DataFrame:
        """The rows of `first`, unique by hash, whose hash no run has."""
        for run in (r for level in reversed(self.levels) for r in level):
            first = first.join(self.spark.table(run).hint("merge"), HASH, "left_anti")
        return first

    def add(self, hashes: DataFrame) -> None:
        """A run of these hashes, which are in no other run; then compaction where a level is full."""
        self._put(0, hashes)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self.spark.table(runs[0])
            for r in runs[1:]:
                merged = merged.unionByName(self.spark.table(r))
            self._put(level + 1, merged)
            for r in runs:
                self._drop(r)
            level += 1

    def _put(self, level: int, hashes: DataFrame) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        spread = hashes.select(*HASH).repartition(self.buckets, *HASH)
        spread.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", folder(self.spark)).saveAsTable(name, format="parquet")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        from .shared import drop

        path = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {name}")
        drop(self.spark, path)

    def close(self) -> None:
        for level in self.levels:
            for r in level:
                self._drop(r)
        self.levels = []


def line_dedup(docs: DataFrame, min_chars: int = 40, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, with all their columns, whose repeated lines are gone.

    Of every line of at least min_chars characters only the first place stays,
    by (id, line number), over all documents; shorter lines stay everywhere.
    Lines end at "\\n" and are equal if their 128-bit hashes are. The documents
    come as `batches` batches by ranges of the id: each is merge-anti-joined
    with the runs of those before and adds its own run. Null and empty texts
    stay as they are; a null id counts as the lowest; rows of one id share their
    places, so whole repeated rows come out equal. A text that loses every line
    becomes empty. Other columns may have any names.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    numeric = docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    key = F.col("_id") if numeric else F.xxhash64("_id")
    cuts = slim.select(F.percentile_approx(key, [i / batches for i in range(1, batches)], 1000)).first()[0] if numeric and batches > 1 else None
    number = F.lit(0)
    for c in sorted(set(cuts or [])):
        number = number + F.when(key > c, 1).otherwise(0)
    lines = slim.where(F.length("_text") >= min_chars).select("_id", number.alias("_b"), F.posexplode(F.split("_text", "\n", -1)).alias("_n", "_line")).where(F.length("_line") >= min_chars)
    lines = written(lines.select("_b", "_id", "_n", F.xxhash64("_line").alias("h1"), F.xxhash64(F.lit(7), "_line").alias("h2")), "_b")
    runs, kept = Runs(spark, fanout), None
    many = sorted(r[0] for r in lines.select("_b").distinct().collect())
    for b in many:
        first = lines.where(F.col("_b") == b).groupBy(*HASH).agg(F.min(F.struct("_id", "_n")).alias("_at"))
        new = written(runs.new(first).select(*HASH, "_at._id", "_at._n"))
        if b != many[-1]:
            runs.add(new)
        kept = new if kept is None else kept.unionByName(new)
    runs.close()
    if kept is None:
        return docs
    places = kept.groupBy("_id").agg(F.collect_list("_n").alias("_kept"))
    names = docs.columns
    at = names.index(text_col)
    inner = [f"_c{i}" for i in range(len(names))]
    schema = docs.schema
    plain = docs.toDF(*inner)
    joined = plain.join(places.hint("shuffle_hash"), plain[inner[names.index(id_col)]].eqNullSafe(places["_id"]), "left").select(*inner, "_kept")

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, kept = batch.column(at).to_pylist(), batch.column(len(inner)).to_pylist()
            out = []
            for t, k in zip(texts, kept):
                if t is None or len(t) < min_chars:
                    out.append(t)
                    continue
                k, parts = set(k or ()), t.split("\n")
                left = [x for i, x in enumerate(parts) if len(x) < min_chars or i in k]
                out.append(t if len(left) == len(parts) else "\n".join(left))
            cols = [batch.column(i) for i in range(len(inner))]
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, inner)

    flat = StructType()
    for i, f in zip(inner, schema):
        flat = flat.add(i, f.dataType, True)
    return joined.mapInArrow(cut, flat).toDF(*names)
