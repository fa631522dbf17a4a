"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorlake.llm import decontaminate, line_dedup, minhash, quality, queries
from tremorlake.llm.shared import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    kept = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had text and has none left goes too."""
    cut = line_dedup.line_dedup(docs)
    return cut.where((F.trim("text") != "") | F.col("text").isNull() | (F.col("n_chars") == 0)).withColumn("n_chars", F.length("text").cast("bigint"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays."""
    return minhash.near_dedup(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in bins of tokens, as op10_best_fit_packing has them."""
    return queries.packed(docs)


STAGES = [("quality", good), ("line_dedup", lines), ("near_dedup", near), ("decontamination", leaks), ("packing", pack)]
#: Sketches, the automaton and packing have no SQL; tests hold run() against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
