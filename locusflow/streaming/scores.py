"""Score statistics over a stream: associative sums, so the batch aggregation serves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_scores(rows: DataFrame, annotations: list[str], block: str = "jk", gradient: str = "grad") -> DataFrame:
    """Running sums of gradient times annotation by annotation and jackknife block.

    ``rows`` may be a streaming frame (output mode update or complete): the state has one
    row per annotation and block, however long the stream runs.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("annot"), F.col(a).cast("double").alias("a")) for a in annotations])
    long = rows.select(F.col(block).alias("jk"), F.col(gradient).alias("grad"), F.explode(pairs).alias("p"))
    return long.groupBy("p.annot", "jk").agg(F.sum(F.col("grad") * F.col("p.a")).alias("u"), F.count("*").alias("n"))
