"""Files that queries write in order to read them as a user's files are read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession) -> str:
    """A path of its own below ``spark.checkpoint.dir``; in a local session without that
    setting, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-files-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str, ending: str = "", **options) -> str:
    """Where ``df`` was written to; ``ending`` closes the path."""
    path = scratch_path(df.sparkSession) + ending
    df.write.format(kind).options(**options).save(path)
    return path


def headed(lines: DataFrame, header: list[str]) -> DataFrame:
    """Lines (value) with the header's before those of each partition."""
    def run(batches):
        for values in chain([pa.array(header, pa.string())], (batch.column(0).cast(pa.string()) for batch in batches)):
            yield pa.RecordBatch.from_arrays([values], names=["value"])

    return lines.mapInArrow(run, "value string")


def written_lines(df: DataFrame, header: list[str], columns: list[str], ending: str = "", separator: str = "\t") -> str:
    """A folder of text files: the rows of ``df`` by its first column, a range of it and the
    header lines in each, as the readers of such files take them."""
    if df.isEmpty():
        return written(df.sparkSession.createDataFrame([(x,) for x in header], "value string").coalesce(1), "text", ending)
    body = df.select(F.col(df.columns[0]).cast("long").alias("at"), F.concat_ws(separator, *[F.col(c).cast("string") for c in columns]).alias("value"))
    return written(headed(body.repartitionByRange("at").sortWithinPartitions("at").select("value"), header), "text", ending)
