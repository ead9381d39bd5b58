"""Summary statistics: LDSC text, GWAS-VCF and multi-trait Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ieee_div, is_finite
from .bgzf import is_bgzf, read_bgzf_vcf

# Column aliases (the first present wins) and VCF FORMAT keys.
ALIASES = {
    "SNP": ("site_ids", "SNP", "rsid"), "CHR": ("chrom", "CHR"), "POS": ("position", "POS", "BP"),
    "REF": ("ref", "REF", "A2"), "ALT": ("alt", "ALT", "A1"), "N": ("N", "n"),
}
FORMAT_REQUIRED, FORMAT_ALLOWED = ("ES", "SE", "LP"), ("ES", "SE", "LP", "NS", "EZ", "SI", "NC", "AF", "AC")


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def keep_complete(df: DataFrame, n_col: str, maximum_missingness: float) -> DataFrame:
    """Rows with N of at least (1 - missingness) times the largest; null N is dropped."""
    n = F.col(n_col)
    most = df.agg(F.max(F.when(~F.isnan(n), n))).first()[0]
    return df.where(n >= (1 - maximum_missingness) * most) if most is not None else df.limit(0)


def add_positions(df: DataFrame, positions: DataFrame | None) -> DataFrame:
    """CHR and POS by SNP (inner), unless both are there; Spark chooses the join."""
    if {"CHR", "POS"} <= set(df.columns) or positions is None:
        return df
    where = positions.select(F.col("site_ids").alias("SNP"), F.col("chrom").cast("long").alias("CHR"), F.col("position").cast("long").alias("POS"))
    return df.drop("CHR", "POS").join(where, "SNP")


def read_positions(spark: SparkSession, path: str, alleles: bool = False) -> DataFrame:
    df = spark.read.csv(path, header=True)
    wanted = ["chrom", "site_ids", "position", *(["anc_alleles", "deriv_alleles"] if alleles else [])]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"positions file lacks {missing}")
    return df.select(*wanted)


def read_ldsc_sumstats(spark: SparkSession, path: str, positions: DataFrame | None = None, maximum_missingness: float = 1.0) -> DataFrame:
    """SNP, N, Z, ALT, REF (and CHR, POS): Z as given or Beta / se."""
    df = _tsv(spark, path)
    if "Z" in df.columns:
        z = F.col("Z").try_cast("double")
    elif {"Beta", "se"} <= set(df.columns):
        z = ieee_div(F.col("Beta").try_cast("double"), F.col("se").try_cast("double"))
    else:
        raise ValueError("needs a column Z, or Beta and se")
    if missing := [c for c in ("SNP", "N", "A1", "A2") if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    place = [F.col(c).try_cast("long").alias(c) for c in ("CHR", "POS") if {"CHR", "POS"} <= set(df.columns)]
    out = df.select("SNP", *place, F.col("N").try_cast("double").alias("N"), z.alias("Z"), F.col("A1").alias("ALT"), F.col("A2").alias("REF"))
    return keep_complete(add_positions(out, positions), "N", maximum_missingness)


def read_ldsc_snplist(spark: SparkSession, path: str, positions: DataFrame | None = None) -> DataFrame:
    return add_positions(_tsv(spark, path).select("SNP", "A1", "A2"), positions)


def validate_format(formats: list[str]) -> None:
    for f in formats:
        keys = f.split(":")
        if missing := [k for k in FORMAT_REQUIRED if k not in keys]:
            raise ValueError(f"FORMAT {f} lacks {missing}")
        if odd := [k for k in keys if k not in FORMAT_ALLOWED]:
            raise ValueError(f"FORMAT {f} has unknown keys {odd}")


def split_sample(df: DataFrame, sample: str) -> DataFrame:
    """One column per FORMAT key, each row read by its own FORMAT; fields left out at the end are null."""
    formats = [r.FORMAT for r in df.select("FORMAT").distinct().collect()]  # as many as a file has layouts
    validate_format(formats)
    keys = [k for k in FORMAT_ALLOWED if any(k in f.split(":") for f in formats)]
    names, values = F.split("FORMAT", ":"), F.split(F.col(sample), ":")
    field = lambda k: F.get(values, (F.array_position(names, F.lit(k)) - 1).cast("int"))
    number = lambda k: F.when(F.array_contains(names, k), field(k).try_cast("double"))
    out = df.select(*[c for c in df.columns if c not in ("FORMAT", sample)], *[number(k).alias(k) for k in keys])
    out = out.withColumn("Z", ieee_div(F.col("ES"), F.col("SE")))
    return out.where(F.col("Z").isNotNull() & ~F.isnan("Z"))


def read_gwas_vcf(spark: SparkSession, path: str, num_rows: int | None = None, maximum_missingness: float = 0.1, **region) -> DataFrame:
    """A GWAS-VCF with one sample.  A file compressed in blocks is read by several tasks, in one
    scan besides that of the largest NS, and takes a ``region`` (chromosome, low, high)."""
    if path.lower().endswith((".gz", ".bgz")) and is_bgzf(path):
        df = read_bgzf_vcf(spark, path, FORMAT_ALLOWED, num_rows, **region).drop("FORMAT")
        df = df.withColumn("Z", ieee_div(F.col("ES"), F.col("SE"))).where("CHR IS NOT NULL AND Z IS NOT NULL AND NOT isnan(Z)")
        return keep_complete(df, "NS", maximum_missingness) if "NS" in df.columns else df
    if region:
        raise ValueError("only a file compressed in blocks takes a region")
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError("no #CHROM header")
    names = head.value.split("\t")
    samples = names[names.index("FORMAT") + 1:] if "FORMAT" in names else []
    if len(samples) != 1:
        raise ValueError("exactly one sample column is needed behind FORMAT")
    df = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"`{n}` string" for n in names))
    df = split_sample(df.limit(num_rows) if num_rows else df, samples[0])
    df = df.withColumn("CHR", F.regexp_replace("#CHROM", "chr", "").try_cast("long")).where("CHR IS NOT NULL").drop("#CHROM")
    df = df.withColumn("POS", F.col("POS").try_cast("long"))
    return keep_complete(df, "NS", maximum_missingness) if "NS" in df.columns else df


def parquet_traits(spark: SparkSession, path: str) -> list[str]:
    """Traits by name; one with only a BETA or only an SE column is an error."""
    names = set(spark.read.parquet(path).columns)
    traits = {c[:-5] for c in names if c.endswith("_BETA")} | {c[:-3] for c in names if c.endswith("_SE")}
    if half := sorted(f"{t}{end}" for t in traits for end in ("_BETA", "_SE") if f"{t}{end}" not in names):
        raise ValueError(f"missing columns {half}")
    return sorted(traits)


def _resolved(columns: list[str]) -> dict[str, str]:
    return {to: found for to, options in ALIASES.items() if (found := next((o for o in options if o in columns), None))}


def read_parquet_sumstats(spark: SparkSession, path: str, trait: str | None = None, maximum_missingness: float = 1.0) -> DataFrame:
    """One trait of a wide table; the scan reads only that trait's columns."""
    known = parquet_traits(spark, path)
    trait = trait or (known[0] if known else None)
    if trait not in known:
        raise ValueError(f"no trait {trait}; there are {known}")
    df = spark.read.parquet(path)
    names = _resolved(df.columns)
    n = F.col(names["N"]).cast("double") if "N" in names else F.lit(None).cast("double")
    out = df.select(*[F.col(c).alias(to) for to, c in names.items() if to != "N"], ieee_div(F.col(f"{trait}_BETA"), F.col(f"{trait}_SE")).alias("Z"), n.alias("N"))
    out = out.where(is_finite(F.col("Z")))
    return keep_complete(out, "N", maximum_missingness) if "N" in names and maximum_missingness < 1 else out


def read_parquet_sumstats_multi(spark: SparkSession, path: str, traits: list[str] | None = None, maximum_missingness: float = 1.0) -> DataFrame:
    """All traits as rows (trait, Z, ...) from one scan; N is the table's, so missingness is too."""
    known = parquet_traits(spark, path)
    traits = traits or known
    if unknown := sorted(set(traits) - set(known)):
        raise ValueError(f"unknown traits {unknown}")
    df = spark.read.parquet(path)
    names = _resolved(df.columns)
    pairs = F.array(*[F.struct(F.lit(t).alias("trait"), ieee_div(F.col(f"{t}_BETA"), F.col(f"{t}_SE")).alias("Z")) for t in traits])
    if "N" in names and maximum_missingness < 1:
        df = keep_complete(df, names["N"], maximum_missingness)
    long = df.select(*[F.col(c).alias(to) for to, c in names.items()], F.explode(pairs).alias("_t"))
    return long.select("_t.trait", *names, "_t.Z").where(is_finite(F.col("Z")))


def read_sumstats(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the file's extension."""
    low = path.lower()
    readers = {(".vcf", ".vcf.gz"): read_gwas_vcf, (".parquet",): read_parquet_sumstats, (".sumstats", ".sumstats.gz"): read_ldsc_sumstats, (".snplist",): read_ldsc_snplist}
    reader = next((r for ends, r in readers.items() if low.endswith(ends)), None)
    if reader is None:
        raise ValueError(f"unknown kind of file: {path}")
    return reader(spark, path, **options)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union over differing columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
