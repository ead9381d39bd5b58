"""What the operators of this subpackage share: tables, scratch tables, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, rows: int, by: list[str]) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer), chosen by a hash of the columns ``by``:
    the same rows however the table is laid out.  Neither sorts nor shuffles; save it to
    use it twice.  Repeated rows share a hash, so no partition gives more than ``rows``."""
    n = df.count()
    if n <= rows:
        return df
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    drawn = df.where(F.pmod(F.xxhash64(F.lit(17), *by), F.lit(1 << 40)) < F.lit(int((1 << 40) * rows / n)))
    return drawn.withColumn("_inside", inside).where(F.col("_inside") < rows).drop("_inside")


@contextmanager
def settings(spark: SparkSession, **values):
    """Session settings for the time of a block (dots as double underscores)."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors share one process, and so one file system."""
    return spark.sparkContext.master.split("[")[0] == "local"


class Scratch:
    """Intermediate tables as Parquet below ``spark.checkpoint.dir``.

    They cut lineage, survive lost executors and are read again at no further
    computation.  ``drop`` frees a table that nothing needs any more.  Where the
    setting is absent, a local session uses a temporary folder, which is removed when
    Python ends; on a cluster it is an error, since a folder of one machine is no
    place for tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not is_local(spark):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spark-scratch-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        self.root = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, written and read again.  Arrow batches are kept to 2,000 rows
        (Spark bounds their bytes too) for as long as the writing takes."""
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        with settings(self.spark, spark__sql__execution__arrow__maxRecordsPerBatch=2000):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *tables: DataFrame) -> None:
        """Frees the files of saved tables by overwriting them with an empty table."""
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                self.spark.range(0).write.mode("overwrite").parquet(path)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about ``most`` bytes of a string column (elements of a list column),
    one row at least, so that what a function makes of a slice stays small beside a task."""
    for batch in batches:
        ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset:][:batch.num_rows + 1] if batch.num_rows else []
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


BITS = 1 << 24


def bit_filter(df: DataFrame, column: str, bits: int = BITS):
    """A broadcast filter of fixed size (``bits``) over a long column: ``maybe_in`` is true
    for every value of the column, and for few others while the column has far fewer
    values than bits.  It only ever spares work; what passes is joined as usual."""
    at = F.pmod(F.col(column), F.lit(bits))
    words = df.select(F.shiftright(at, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table_ = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most bits / 64 rows
        table_[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return df.sparkSession.sparkContext.broadcast(table_)


def maybe_in(table_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x.astype(np.int64) % (64 * len(table_))
    return (table_[at >> 6] >> (at & 63)) & 1 == 1


def fresh_name(taken: list[str], wanted: str) -> str:
    while wanted in taken:
        wanted = f"_{wanted}"
    return wanted


def rank_within(rows: DataFrame, keys: list[str], name: str, scratch: Scratch, chunk: int = 4096) -> DataFrame:
    """Adds ``name``, 0 to n - 1 among the rows of equal keys (never null), in some fixed order.

    Rows of a key are dealt into chunks of about ``chunk`` rows by their place in a saved
    table, so equal rows spread too; counts of chunks are summed, and rows ranked inside.
    The tables of keys and chunks are saved: while they are small, Spark broadcasts them
    and ``rows`` are shuffled once, for the ranks.
    """
    row, part, total, before = (fresh_name(rows.columns, x) for x in ("row_", "part_", "total_", "before_"))
    rows = (rows if getattr(rows, "_scratch_path", None) else scratch.save(rows)).withColumn(row, F.monotonically_increasing_id())
    totals = scratch.save(rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias(total)))
    dealt = rows.join(totals, keys).withColumn(part, F.pmod(F.xxhash64(row), F.col(total))).drop(total)
    counts = dealt.groupBy(*keys, part).agg(F.count("*").alias(before))
    upto = F.sum(before).over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, 0))
    starts = scratch.save(counts.withColumn(before, upto - F.col(before)))
    inside = F.row_number().over(W.partitionBy(*keys, part).orderBy(row)) - 1
    return dealt.join(starts, [*keys, part]).withColumn(name, F.col(before) + inside).drop(row, part, before)


def spread_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join of ``left`` (saved) with ``right``, whose keys are unique: a key that more
    than one in ``share`` rows of ``left`` have is dealt over many partitions, and its row of
    ``right`` goes to each.  There are at most ``share`` such keys."""
    total = left.count()
    counts = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * share > total)
    hot = {r[key]: min(n_partitions(left.sparkSession), -(-r["_n"] * share // total)) for r in counts.where(F.col(key).isNotNull()).collect()}
    if not hot:
        return left.join(right, key, "left")
    table_ = left.sparkSession.createDataFrame(list(hot.items()), f"`{key}` {dict(left.dtypes)[key]}, _parts int")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(F.broadcast(table_), key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_parts")
    copies = right.join(F.broadcast(table_), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of ``edges`` (src, dst): rows (node, component), component
    the smallest node reachable.  Nodes without an edge don't appear.

    Alternating large-star and small-star rounds: every round is a few joins and
    aggregations over the edges that are left, whose number never grows.  The
    neighbours of a hub are reduced by partial aggregation; the join that hands
    the minimum back is one that adaptive execution splits when skewed.
    """
    scratch = scratch or Scratch(spark)
    edges = scratch.save(
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.pmod("v", F.lit(1000003)))).first()
        if now[0] == 0 or tuple(now) == mark:
            break
        mark = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.save(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edges, large)
        edges = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
