"""Every query of the library by name, with its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import file_queries as _  # registers its queries
from .catalog import ORACLES, QUERIES, q_score_test

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enrichment score test."""
    return q_score_test(spark, sf_dir)
