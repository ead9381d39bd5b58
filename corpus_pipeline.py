"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of ``documents``, whatever more columns there are and however they are called.

Defined results: null and blank texts have too few words and go in the first stage;
null ids are kept like others until the near duplicates, which leave rows without an id
alone; a null source is one of its own; repeated rows are one group of near duplicates,
of which the smallest id stays with all its rows; of equal texts with different ids one
stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm.common import Scratch, table
from locusflow.llm.jaccard import jaccard_stage
from locusflow.llm.linededup import linededup_stage
from locusflow.llm.mixing import mixing_stage
from locusflow.llm.packing import packing_stage
from locusflow.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", linededup_stage),
    ("jaccard_join", jaccard_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The template tree of line dedup has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
