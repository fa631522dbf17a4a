"""Registry of the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import analyze, impact, measures, retrieval, upkeep  # noqa: F401
from .plans.registry import ORACLE, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of every request, with propagation and all gates."""
    return analyze.analyze_v7(spark, sf_dir)
