"""Row order made explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Adds the position of every row in the order Spark reads the source.

    Only the row count of each partition reaches the driver.  Use it right behind a
    scan, whose partitions are the same each time it runs.
    """
    shift = 1 << 33
    part, at, before = (fresh_name(df.columns, x) for x in ("part_", "at_", "before_"))
    counts = {r.p: r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, {before} long")  # a row per partition
    placed = df.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id() - F.col(part).cast("long") * shift)
    return placed.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(at)).drop(part, at, before)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given total order."""
    at = "_keep_first"
    return df.withColumn(at, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(at) == 1).drop(at)


def fresh_name(taken: list[str], wanted: str) -> str:
    while wanted in taken:
        wanted = f"_{wanted}"
    return wanted
