"""LD blocks: metadata, edge lists and variant lists, keyed by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordinal import with_ordinal
from ..operators.joins import small

# The columns of block metadata and the shape of block file names.
METADATA_COLUMNS = ("chrom", "chromStart", "chromEnd", "name", "snplistName", "population", "numVariants", "numIndices", "numEntries", "info")
NAME_PATTERN = r"1kg_chr(\d+)_(\d+)_(\d+)\.(\w+)\.edgelist"


def read_metadata(spark: SparkSession, path: str, populations: list[str] | None = None, chromosomes: list[int] | None = None, max_blocks: int | None = None) -> DataFrame:
    """Block metadata in order of chromosome and start, with ``block_id``; filters that leave nothing raise."""
    df = spark.read.csv(path, header=True)
    if missing := [c for c in METADATA_COLUMNS if c not in df.columns]:
        raise ValueError(f"metadata lacks {missing}")
    numbers = [c for c in METADATA_COLUMNS if c.startswith(("chrom", "num"))]
    df = df.withColumns({c: F.col(c).cast("bigint") for c in numbers})
    for column, wanted in (("population", populations), ("chrom", chromosomes)):
        if wanted:
            df = df.where(F.col(column).isin(list(wanted)))
            if df.isEmpty():
                raise ValueError(f"no block with {column} in {wanted}")
    df = df.orderBy("chrom", "chromStart", "population", "name")
    df = df.limit(max_blocks) if max_blocks else df
    return df.withColumn("block_id", (F.row_number().over(W.orderBy("chrom", "chromStart", "population", "name")) - 1).cast("long"))


def read_edges(spark: SparkSession, folder: str, blocks: DataFrame) -> DataFrame:
    """(block_id, i, j, value) of the blocks' edge lists, from one scan."""
    df = spark.read.schema("i int, j int, value double").option("pathGlobFilter", "*.edgelist").csv(folder)
    df = df.withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.join(small(blocks.select("block_id", "name")), "name").select("block_id", "i", "j", "value")


def read_snplists(spark: SparkSession, folder: str, blocks: DataFrame, population: str = "EUR") -> DataFrame:
    """(block_id, ordinal, index, site_ids, position, alleles, af) of the blocks' variant lists."""
    df = spark.read.option("pathGlobFilter", "*.snplist").csv(folder, header=True)
    column = population if population in df.columns else "af" if "af" in df.columns else None
    if column is None:
        raise ValueError(f"neither {population} nor af is a column")
    df = with_ordinal(df.withColumn("snplistName", F.element_at(F.split(F.input_file_name(), "/"), -1)))
    df = df.join(small(blocks.select("block_id", "snplistName", F.col("chrom").alias("CHR"))), "snplistName")
    return df.select("block_id", "ordinal", F.col("index").cast("int").alias("index"), "site_ids", F.col("position").cast("bigint").alias("position"), "anc_alleles", "deriv_alleles", F.col(column).cast("double").alias("af"), "CHR")


def block_annotations(variants: DataFrame) -> DataFrame:
    """Variant lists in the columns of an annotation table."""
    return variants.select("CHR", F.col("position").alias("POS"), F.col("site_ids").alias("SNP"), F.col("anc_alleles").alias("A2"), F.col("deriv_alleles").alias("A1"), F.lit(1.0).alias("base"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both triangles; the diagonal counts once."""
    return edges.unionByName(edges.where("i <> j").select("block_id", F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def compact(edges: DataFrame, variants: DataFrame, snps_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Indices with a non-zero diagonal, renumbered from 0 in order; variants without one go."""
    live = edges.where("i = j AND value <> 0").select("block_id", "i").distinct()
    live = live.withColumn("new", (F.dense_rank().over(W.partitionBy("block_id").orderBy("i")) - 1).cast("int"))
    left, right = live.select("block_id", "i", F.col("new").alias("ni")), live.select("block_id", F.col("i").alias("j"), F.col("new").alias("nj"))
    e = edges.join(left, ["block_id", "i"]).join(right, ["block_id", "j"]).select("block_id", F.col("ni").alias("i"), F.col("nj").alias("j"), "value")
    v = variants.join(live.withColumnRenamed("i", "index"), ["block_id", "index"]).withColumnRenamed("index", "original_index").withColumnRenamed("new", "index")
    if snps_only:
        v = v.where((F.char_length("anc_alleles") == 1) & (F.char_length("deriv_alleles") == 1))
    return e, v


def create_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata from the block files themselves; files whose names don't fit are skipped."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    e = spark.read.schema("i int, j int, value double").option("pathGlobFilter", "*.edgelist").csv(folder).withColumn("name", name).where(F.col("name").rlike(f"^{NAME_PATTERN}$"))
    e = e.groupBy("name").agg(F.count_distinct(F.when(F.col("i") == F.col("j"), F.col("i"))).alias("numIndices"), F.count("*").alias("numEntries"))
    part = lambda k: F.regexp_extract("name", NAME_PATTERN, k)
    e = e.select(*[part(k).cast("bigint").alias(c) for k, c in ((1, "chrom"), (2, "chromStart"), (3, "chromEnd"))], "name", F.regexp_replace("name", r"\.\w+\.edgelist$", ".snplist").alias("snplistName"), part(4).alias("population"), "numIndices", "numEntries")
    s = spark.read.option("pathGlobFilter", "*.snplist").csv(folder, header=True).groupBy(name.alias("snplistName")).agg(F.count("*").alias("numVariants"))
    return e.join(s, "snplistName", "left").withColumn("numVariants", F.coalesce("numVariants", F.lit(0))).withColumn("info", F.lit("")).select(*METADATA_COLUMNS).orderBy("chrom", "chromStart")
