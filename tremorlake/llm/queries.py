"""Queries of the training-data operators over their whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, licences, line_dedup, minhash, neighbours, packing, quality, shard_katz, token_counts

TOKENIZER = os.environ.get("TREMORLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is indexed; the queries are the rows whose id is divisible by 100, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(e, queries=e.where("vec_id % 100 = 0"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id.txt; a short text that speaks of a licence is the licence file of its directory."""
    short = (F.length("text") <= 400) & F.col("text").rlike("(?i)licen[cs]e")
    name = F.when(short, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return licences.license_scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", name))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_katz.word_katz(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("bigint"))


def packed(docs: DataFrame) -> DataFrame:
    """Documents by their token counts in bins of 4096 tokens."""
    return packing.pack(token_counts.token_counts(docs, TOKENIZER), 4096, size="n_tokens")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


LINE_DEDUP_SQL = """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM s),
k AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS rn FROM l),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM k WHERE length(line) < 40 OR rn = 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text, d.lang, d.source, length(coalesce(t.text, '')) AS n_chars
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_nearest_neighbours, op3_near_duplicates, op4_decontamination, op5_quality_classifier, op6_chat_format, op7_license_scan, op8_lm_scoring, op9_line_dedup, op10_best_fit_packing)}
CHAT_SQL = r"""
WITH m AS (SELECT conv_id, turn, role, text, regexp_matches(role || chr(10) || text, '<\|im_(start|end)\|>') OR regexp_matches(role || chr(10) || text, '<\\+\|') OR text = '<|null|>' OR role = '<|null|>' OR contains(role, chr(10)) OR contains(role, '<|nl|>') AS bad FROM conversations),
r AS (SELECT conv_id, turn, role, text, bad, CASE WHEN bad THEN replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>') ELSE role END AS er, CASE WHEN bad THEN regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') ELSE text END AS et FROM m)
SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_escaped, string_agg('<|im_start|>' || er || chr(10) || et || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM r GROUP BY conv_id
"""
ORACLE = {"op6_chat_format": CHAT_SQL, "op9_line_dedup": LINE_DEDUP_SQL}
