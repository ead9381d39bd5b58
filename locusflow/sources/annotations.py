"""Annotations, regions, genes and gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordinal import with_ordinal
from .sumstats import union_all

COORDINATES = ("CHR", "BP", "POS", "SNP", "CM", "A1", "A2")
# The columns of a BED file and of a gene table, in order.
BED_COLUMNS = [("chrom", "string"), ("chromStart", "bigint"), ("chromEnd", "bigint"), ("name", "string"), ("score", "bigint"), ("strand", "string"), ("thickStart", "bigint"), ("thickEnd", "bigint"), ("itemRgb", "string"), ("blockCount", "bigint"), ("blockSizes", "string"), ("blockStarts", "string")]
#: Doubled midpoints of genes below this, either sign, are told apart by one number with the chromosome.
GENE_SPAN = 1 << 57
GENE_SCHEMA = "gene_id string, gene_id_version string, gene_name string, start bigint, `end` bigint, CHR string"


def files_below(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Files of a folder by glob, sorted; through Spark's file systems."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return sorted(r.path for r in found.collect())


def read_bed(spark: SparkSession, path: str, min_fields: int = 3, max_fields: int = 12, zero_based: bool = True) -> DataFrame:
    """Regions; header, comment and blank lines are skipped, a wrong field count or number raises."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike("^(browser|track|#)"))
    parts = F.split("line", r"\s+")
    n = F.size("parts")
    bad = (n < min_fields) | (n > max_fields)
    lines = lines.select(parts.alias("parts"), "line").select(F.when(bad, F.raise_error(F.concat(F.lit("wrong number of BED fields: "), F.col("line"))).cast("array<string>")).otherwise(F.col("parts")).alias("parts"))
    out = lines.select(*[F.get("parts", F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(BED_COLUMNS[:max_fields])])
    return out if zero_based else out.withColumn("chromStart", F.col("chromStart") - 1)


def bed_chromosome(c) -> object:
    return F.regexp_replace(c, "^chr", "").cast("bigint")


def detect_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns whose distinct values are exactly 0 and 1 become Boolean; one aggregation for all."""
    if not columns:
        return df
    tests = [((F.min(c) == 0) & (F.max(c) == 1) & (F.count_if(~F.col(c).isin(0, 1)) == 0)).alias(c) for c in columns]
    found = df.agg(*tests).first()
    return df.withColumns({c: F.col(c).cast("boolean") for c in columns if found[c]})


def read_annot(spark: SparkSession, path: str) -> DataFrame:
    """One .annot file, numbers typed from the header alone."""
    df = spark.read.csv(path, sep="\t", header=True)
    kinds = {"SNP": "string", "A1": "string", "A2": "string", "CHR": "bigint", "BP": "bigint", "POS": "bigint"}
    return df.select(*[F.col(c).try_cast(kinds.get(c, "double")).alias(c) for c in df.columns])


def load_annotations(spark: SparkSession, path: str, chromosomes: list[int] | None = None, positions: DataFrame | None = None, pattern: str = "*.{chrom}.annot*", exclude_bed: bool = False) -> DataFrame:
    """Annotations of all chromosomes: the files of one chromosome are laid side by side
    by row (columns already seen are skipped), chromosomes are unioned, columns of 0 and
    1 become Boolean, each BED file adds a Boolean column."""
    from ..operators.joins import bed_membership

    frames = []
    for chrom in chromosomes or range(1, 23):
        wide = None
        for f in files_below(spark, path, pattern.format(chrom=chrom)):
            one = with_ordinal(read_annot(spark, f))
            if wide is None:
                wide = one
            else:
                new = [c for c in one.columns if c not in wide.columns]
                wide = wide.join(one.select("ordinal", *new), "ordinal") if new else wide
        if wide is not None:
            if "CHR" not in wide.columns:
                wide = zip_coordinates(wide, positions, chrom)
            frames.append(wide.drop("ordinal"))
    if not frames:
        raise FileNotFoundError(f"no annotation files below {path}")
    out = union_all(frames)
    if "POS" not in out.columns and "BP" in out.columns:
        out = out.withColumnRenamed("BP", "POS")
    out = detect_binary(out, [c for c in out.columns if c not in COORDINATES])
    for f in [] if exclude_bed else files_below(spark, path, "*.bed"):
        out = bed_membership(out, read_bed(spark, f), f.rsplit("/", 1)[-1].removesuffix(".bed"))
    return out


def zip_coordinates(thin: DataFrame, positions: DataFrame | None, chrom: int) -> DataFrame:
    """Coordinates (and alleles, if the positions have them) by row order for a file that has
    annotation columns only; counts must agree."""
    if positions is None:
        raise ValueError("annotation files without coordinates need a positions table")
    mine = with_ordinal(positions.where(F.col("chrom") == chrom)).select("ordinal", F.col("chrom").cast("bigint").alias("CHR"), F.col("position").cast("bigint").alias("BP"), F.col("site_ids").alias("SNP"), *[F.col(c).alias(to) for c, to in (("anc_alleles", "A2"), ("deriv_alleles", "A1")) if c in positions.columns])
    if (a := thin.count()) != (b := mine.count()):
        raise ValueError(f"{a} annotation rows but {b} positions on chromosome {chrom}")
    return thin.join(mine, "ordinal")


def rows_as_annotations(rows: DataFrame, chromosomes: list[int] | None = None) -> DataFrame:
    """Row data of a variant store in the columns of an annotation table."""
    out = rows.select(F.col("CHR").cast("bigint").alias("CHR"), F.col("POS").cast("bigint").alias("POS"), F.col("RSID").alias("SNP"), F.lit(0.0).alias("CM"))
    return out.where(F.col("CHR").isin(list(chromosomes))) if chromosomes else out


def load_variant_annotations(spark: SparkSession, path: str, rows: DataFrame, names: list[str] | None = None, chromosomes: list[int] | None = None, exclude_bed: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """(annotations, names, merge keys) for the rows of a variant store: RSID is the key, or
    (CHR, POS) where the files have no ids.  A folder of BED files alone takes its
    coordinates from the rows.  Columns are in order of their names."""
    from ..operators.joins import bed_membership

    if files_below(spark, path, "*.annot*"):
        found = load_annotations(spark, path, chromosomes, exclude_bed=exclude_bed)
    else:
        beds = [] if exclude_bed else files_below(spark, path, "*.bed")
        if not beds:
            raise FileNotFoundError(f"no annotation files below {path}")
        found = rows_as_annotations(rows, chromosomes)
        for f in beds:
            found = bed_membership(found, read_bed(spark, f), f.rsplit("/", 1)[-1].removesuffix(".bed"))
    keys = ["RSID"] if "SNP" in found.columns else ["CHR", "POS"]
    found = found.withColumnRenamed("SNP", "RSID")
    known = sorted(c for c in found.columns if c not in (*COORDINATES, "RSID"))
    if unknown := sorted(set(names or []) - set(known)):
        raise ValueError(f"no annotations {unknown}; there are {known}")
    chosen = [c for c in known if not names or c in names]
    return found.select(*keys, *chosen), chosen, keys


def gene_set_columns(spark: SparkSession, path: str, variants: DataFrame, genes: DataFrame, weights: tuple[float, ...] | None = None, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(variant_id and a column per gene set, the sets' names): GMT files as annotations of
    ``variants`` (variant_id, CHR, POS), 0 where no gene of a set is near."""
    from ..operators.joins import NEAREST_WEIGHTS, gene_set_annotations, nearest_genes

    sets = load_gene_sets(spark, path, names)
    found = sorted(r.set_name for r in sets.select("set_name").distinct().collect())  # a row per set
    weights = weights or NEAREST_WEIGHTS
    long = gene_set_annotations(nearest_genes(variants, genes, weights), genes, sets, len(weights) * variants.count())
    wide = long.groupBy("variant_id").pivot("set_name", found).agg(F.first("value"))
    return variants.select("variant_id").join(wide, "variant_id", "left").fillna(0.0, found), found


def binary_subset(df: DataFrame, columns: list[str], parameters: list[float] | None = None) -> tuple[list[str], list[float] | None]:
    """Of ``columns`` those with values 0 and 1 (or Booleans) alone, and their parameters."""
    if parameters is not None and len(parameters) != len(columns):
        raise ValueError("as many parameters as annotations are needed")
    whole = [c for c, kind in df.select(*columns).dtypes if kind in ("boolean", "tinyint", "smallint", "int", "bigint")]
    found = df.agg(*[F.count_if(~F.coalesce(F.col(c).cast("int").isin(0, 1), F.lit(False))).alias(c) for c in whole]).first() if whole else {}
    kept = [c for c in columns if c in whole and found[c] == 0]
    if not kept:
        raise ValueError("no annotation is binary")
    return kept, None if parameters is None else [p for c, p in zip(columns, parameters, strict=True) if c in kept]


def load_gene_table(spark: SparkSession, path: str, chromosomes: list[int] | None = None) -> DataFrame:
    """Autosomal genes with an id, by chromosome and midpoint; ``gene_idx`` is that order,
    counted by a sweep: a sort's partitions need not be the same when it runs again."""
    from ..operators.sweep import running

    df = spark.read.csv(path, sep="\t", header=True, schema=GENE_SCHEMA, enforceSchema=True)
    df = df.where(F.col("gene_id").isNotNull()).withColumn("CHR", F.col("CHR").try_cast("bigint")).where(F.col("CHR").between(1, 22))
    df = df.withColumn("gene_name", F.coalesce("gene_name", F.lit("NA"))).withColumn("midpoint", (F.col("start") + F.col("end")) / 2)
    df = df.withColumn("POS", F.floor("midpoint").cast("bigint"))
    df = df.where(F.col("CHR").isin(list(chromosomes))) if chromosomes else df
    # chromosome and doubled midpoint in one number; the ties order what lies beyond its ends
    twice = F.least(F.greatest(F.col("start") + F.col("end"), F.lit(1 - GENE_SPAN)), F.lit(GENE_SPAN - 1))
    df = df.withColumn("_line", F.col("CHR") * (2 * GENE_SPAN) + F.coalesce(twice, F.lit(-GENE_SPAN)))
    return running(df, F.lit(1), "_line", "gene_idx", ties=("midpoint", "gene_id", "gene_id_version", "gene_name")).drop("_line")


def load_gene_sets(spark: SparkSession, path: str, names: list[str] | None = None, pattern: str = "*.gmt") -> DataFrame:
    """(set_name, gene) of all GMT files; of sets with one name the last line of the last file holds."""
    files = files_below(spark, path, pattern)
    frames = [with_ordinal(spark.read.text(f), "line").withColumn("file", F.lit(i)) for i, f in enumerate(files)]
    if not frames:
        raise FileNotFoundError(f"no GMT files below {path}")
    parts = F.split("value", "\t")
    sets = union_all(frames).where(F.size(parts) >= 3).groupBy(F.get(parts, F.lit(0)).alias("set_name")).agg(F.max_by(F.slice(parts, 3, 1 << 30), F.struct("file", "line")).alias("genes"))
    sets = sets.select("set_name", F.explode("genes").alias("gene")).where("gene <> ''").distinct()
    return sets.where(F.col("set_name").isin(names)) if names else sets
