"""Readers of repositories, ground truth, logs, tables and run reports, all with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import content_hash, source_path

JUSTIFIED = "array<struct<file_path:string,justification:string>>"
GROUND_TRUTH = f"cr_id string, cr_description string, impacted_files {JUSTIFIED}, impacted_entities array<struct<node:string,justification:string>>, _corrupt_record string"
AUDIT = "call_index int, call_name string, status string, config_hash string, model string, timestamp string, prompt_hash string, response_hash string, retry_count int, prompt_tokens int, completion_tokens int, error string"


def repository(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_path, content, content_hash, kind) of the Markdown below docs and the TypeScript anywhere; hidden folders are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx,md}").load(root)
    rel = F.element_at(F.split("path", root.rstrip("/").replace("\\", "/").split("://")[-1] + "/"), -1)
    x = raw.withColumn("rel", rel).where(~F.col("rel").rlike(r"(^|/)\."))
    kind = F.when(F.col("rel").rlike(r"\.md$"), "md").otherwise("ts")
    x = x.withColumn("kind", kind).where((F.col("kind") == "ts") | F.startswith("rel", F.lit("docs/")))
    return x.select("path", F.when(F.col("kind") == "md", F.col("rel")).otherwise(source_path(F.col("rel"))).alias("file_path"), F.col("content").cast("string").alias("content"), content_hash(F.col("content")).alias("content_hash"), "kind")


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each valid JSON file of the folder, by file name; invalid ones are left out."""
    x = spark.read.schema(GROUND_TRUTH).option("multiLine", True).option("mode", "PERMISSIVE").json(folder).withColumn("_file", F.input_file_name())
    return x.where("_corrupt_record IS NULL AND cr_id IS NOT NULL").orderBy("_file").drop("_corrupt_record", "_file")


def json_lines(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """Records of a JSON-lines file; blank and invalid lines are left out."""
    first = schema.split()[0]
    x = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "value")
    valid = F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.coalesce(F.json_object_keys("value").isNotNull(), F.lit(False))
    return x.where(F.col("r").isNotNull() & valid).select("r.*") if first else x


def metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """A collection of vectors; fails where its scores aren't of cosines, which would go wrong silently."""
    space = spark.read.parquet(f"{path}/space").first()[0]
    if space != "cosine":
        raise ValueError(f"the vectors at {path} are of the space {space}, not cosine: they must be indexed again")
    return spark.read.parquet(f"{path}/rows")


def run_steps(spark: SparkSession, path: str, step: str) -> DataFrame:
    """(pos, node_id) of a step's array in a run report."""
    x = spark.read.schema(f"{step} array<struct<node_id:string>>").option("multiLine", True).json(path)
    return x.select(F.posexplode(step).alias("pos", "e")).select("pos", "e.node_id")
