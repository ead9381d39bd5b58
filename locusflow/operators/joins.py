"""Joins of the domain: alleles, blocks, regions, nearest genes, gene sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordinal import fresh_name, keep_first
from .sweep import running

#: A side with at most so many rows may be broadcast.
BROADCAST_ROWS = 100_000
# What coordinates and chromosomes may be called, and the span of a chromosome.
CHROMOSOME_NAMES, POSITION_NAMES = ("chrom", "chromosome", "CHR"), ("position", "POS", "BP")
SPAN = 1_000_000_000
#: Places of genes in a run.
RUN = 64
#: Rows of a task, about, where a step's rows are counted first: at most, and at least while cores are free.
TASK_ROWS, LEAST_ROWS = 250_000, 50_000
#: Over so many tasks the variants near one gene are dealt.
GENE_PARTS = 8
#: Rank weights of a variant's nearest genes.
NEAREST_WEIGHTS = (0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, if ``df`` is counted to be small; else the frame as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def n_tasks(spark: SparkSession, rows: int) -> int:
    """Into how many tasks to deal ``rows`` rows, so that a task's rows don't grow with the table."""
    return max(2, -(-rows // TASK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAST_ROWS)))


def resolve(columns: list[str], wanted: str | None, names: tuple[str, ...]) -> str:
    for name in ([wanted] if wanted else []) + list(names):
        if name in columns:
            return name
    raise ValueError(f"none of {names} is a column")


def allele_phase(anc: Column, deriv: Column, ref: Column, alt: Column) -> Column:
    """1 where (ancestral, derived) = (ref, alt), -1 where swapped, NaN where both are null, else 0."""
    anc, deriv, ref, alt = (F.lower(c) for c in (anc, deriv, ref, alt))
    same = (anc == ref) & (deriv == alt)
    swapped = (anc == alt) & (deriv == ref)
    return F.when(ref.isNull() & alt.isNull(), F.lit(float("nan"))).when(same, F.lit(1.0)).when(swapped, F.lit(-1.0)).otherwise(F.lit(0.0))


def merge_snplists(variants: DataFrame, sumstats: DataFrame, by_position: bool = False, ref: str = "A2", alt: str = "A1", add: tuple[str, ...] = (), add_allelic: tuple[str, ...] = ()) -> DataFrame:
    """Variants of blocks (block_id, index, ordinal, ...) with the statistics of the same
    block that match by id or position: phase, ``add`` as they are and ``add_allelic``
    times phase.  ``is_representative`` marks the first match of each index."""
    if missing := [c for c in (*add, *add_allelic) if c not in sumstats.columns]:
        raise ValueError(f"missing columns {missing}")
    right = sumstats.select("block_id", F.col("ordinal").alias("stats_ordinal"), F.col("POS" if by_position else "SNP").alias("_key"),
                            *[F.col(c).alias(f"_s_{c}") for c in {*add, *add_allelic, *(c for c in (ref, alt) if c in sumstats.columns)}])
    left = variants.withColumn("_key", F.col("position" if by_position else "site_ids"))
    out = left.join(right, ["block_id", "_key"]).drop("_key")
    if {ref, alt} <= set(sumstats.columns):
        out = out.withColumn("phase", allele_phase(F.col("anc_alleles"), F.col("deriv_alleles"), F.col(f"_s_{ref}"), F.col(f"_s_{alt}"))).where(F.col("phase") != 0)
    else:
        out = out.withColumn("phase", F.lit(1.0))
    keep = [c for c in variants.columns if c not in (*add, *add_allelic)]
    out = out.select(*keep, "stats_ordinal", "phase", *[F.col(f"_s_{c}").alias(c) for c in add], *[(F.col(f"_s_{c}") * F.col("phase")).alias(c) for c in add_allelic])
    first = F.row_number().over(W.partitionBy("block_id", "index").orderBy("ordinal", "stats_ordinal"))
    return out.withColumn("is_representative", (first == 1).cast("byte"))


def active_indices(merged: DataFrame) -> DataFrame:
    """Matched indices of each block, renumbered from 0."""
    return merged.withColumn("active", (F.dense_rank().over(W.partitionBy("block_id").orderBy("index")) - 1).cast("int"))


def ranges(lo: Column, hi: Column) -> Column:
    """(level, bin) of the bins that a range lo <= x < hi touches: two at most, of the power of
    two next above its length, so a bin's ranges are as long as the bin or half of it."""
    level = F.length(F.bin(F.ceil(hi) - F.floor(lo))).cast("int")
    at = lambda x: F.call_function("shiftright", x.cast("bigint"), level)
    first, last = at(F.floor(lo)), at(F.ceil(hi) - 1)
    return F.transform(F.array_distinct(F.array(first, last)), lambda x: F.struct(level.alias("level"), x.alias("bin")))


def inside_ranges(points: DataFrame, regions: DataFrame, chrom: Column, pos: Column) -> DataFrame:
    """Points joined to the regions (_c, _lo, _hi, ...) they lie in, _lo <= pos < _hi.

    A region stands in the one or two bins of its own length, a point in one bin for each
    power of two that lengths have, so a point meets few regions that it is not in,
    however many there are and however different their lengths.
    """
    r = regions.where("_lo < _hi").withColumn("_at", F.explode(ranges(F.col("_lo"), F.col("_hi")))).select("*", F.col("_at.level").alias("_level"), F.col("_at.bin").alias("_bin")).drop("_at")
    levels = sorted(x._level for x in r.select("_level").distinct().collect())  # 64 at most
    bins = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(pos, k).alias("bin")) for k in levels]) if levels else F.array().cast("array<struct<level: int, bin: bigint>>")
    p = points.withColumns({"_pc": chrom, "_pp": pos, "_pa": F.explode(bins)})
    on = (F.col("_pc") == F.col("_c")) & (F.col("_pa.level") == F.col("_level")) & (F.col("_pa.bin") == F.col("_bin")) & (F.col("_pp") >= F.col("_lo")) & (F.col("_pp") < F.col("_hi"))
    return p.join(small(r), on).drop("_pc", "_pp", "_pa", "_c", "_lo", "_hi", "_level", "_bin")


def partition_variants(variants: DataFrame, blocks: DataFrame, chromosome: str | None = None, position: str | None = None) -> DataFrame:
    """Variants with the block (or blocks) they lie in, start <= position < end: an equality
    join on (chromosome, bin) that spreads, or whose few blocks are broadcast."""
    chrom, pos = resolve(variants.columns, chromosome, CHROMOSOME_NAMES), resolve(variants.columns, position, POSITION_NAMES)
    b = blocks.select("block_id", F.col("chrom").cast("bigint").alias("_c"), F.col("chromStart").alias("_lo"), F.col("chromEnd").alias("_hi"))
    return inside_ranges(variants, b, variants[chrom].cast("bigint"), variants[pos].cast("bigint"))


def merge_intervals(regions: DataFrame) -> DataFrame:
    """Overlapping or touching regions (chrom, chromStart, chromEnd) merged: a sweep along all
    chromosomes carries the furthest end so far, and another numbers the islands."""
    line = F.coalesce(F.col("chrom").cast("long"), F.lit(-1)) * SPAN
    r = regions.groupBy("chrom", "chromStart").agg(F.max("chromEnd").alias("chromEnd")).withColumn("_start", line + F.col("chromStart"))
    r = running(r, F.col("_start") - F.col("chromStart") + F.col("chromEnd"), "_start", "_reach", "max")
    r = running(r, F.when(F.col("_reach") >= F.col("_start"), 0).otherwise(1), "_start", "_island", inclusive=True)
    return r.groupBy("chrom", "_island").agg(F.min("chromStart").alias("chromStart"), F.max("chromEnd").alias("chromEnd")).drop("_island")


def bed_membership(variants: DataFrame, regions: DataFrame, name: str, chromosome: str | None = None, position: str | None = None) -> DataFrame:
    """Adds a Boolean: does the (1-based) position lie in a (0-based, half-open) region?

    Positions are looked up once each, in merged regions, by a join that keeps every
    variant; no variant is duplicated.
    """
    chrom, pos = resolve(variants.columns, chromosome, CHROMOSOME_NAMES), resolve(variants.columns, position, POSITION_NAMES)
    r = regions.select(F.regexp_replace(F.col("chrom").cast("string"), "^chr", "").cast("bigint").alias("chrom"), "chromStart", "chromEnd")
    r = merge_intervals(r).select(F.col("chrom").alias("_c"), F.col("chromStart").alias("_lo"), F.col("chromEnd").alias("_hi"))
    where = variants.select(F.col(chrom).cast("bigint").alias("_vc"), F.col(pos).cast("bigint").alias("_vp")).distinct()
    hit = inside_ranges(where, r, F.col("_vc"), F.col("_vp") - 1).withColumn("_hit", F.lit(True))  # merged regions: one hit at most
    out = variants.join(hit, (variants[chrom].cast("bigint") == F.col("_vc")) & (variants[pos].cast("bigint") == F.col("_vp")), "left")
    return out.withColumn(fresh_name(variants.columns, name), F.coalesce("_hit", F.lit(False))).drop("_vc", "_vp", "_hit")


def place_runs(places: DataFrame, reach: int) -> DataFrame:
    """(run, first, places): the ranked places of ranks ``RUN`` r to RUN (r + 1) in one sorted
    array, with ``reach`` more carried over from either neighbour; its first rank is ``first``."""
    runs = F.sequence(F.greatest(F.floor((F.col("rank") - reach) / RUN), F.lit(0)), F.floor((F.col("rank") + reach) / RUN))
    each = places.withColumn("run", F.explode(runs)).where((F.col("rank") >= F.col("run") * RUN - reach) & (F.col("rank") < (F.col("run") + 1) * RUN + reach))
    inside = F.sort_array(F.collect_list(F.struct("G", "CHR", "ids")))  # at most RUN + 2 reach
    return each.groupBy("run").agg(inside.alias("places")).withColumn("first", F.greatest(F.col("run") * RUN - reach, F.lit(0)))


def nearest_genes(variants: DataFrame, genes: DataFrame, weights: tuple[float, ...] = NEAREST_WEIGHTS, variant_id: str = "variant_id") -> DataFrame:
    """(variant_id, rank, gene_idx, weight): the k nearest genes of each variant's own
    chromosome; where those run out, genes of other chromosomes by global position.
    Ties go to the smaller gene index.

    A sweep along one line of all chromosomes ranks the genes' different places and finds
    how many lie before each different position of a variant.  Ranks are cut into runs,
    with the places at a run's border carried over from its neighbours, so a position
    joins one run and looks 2k places up and down; variants then take the genes of their
    position.  Neither side is ever gathered, whole or by chromosome.
    """
    k = len(weights)
    if genes.limit(k).count() < k:
        raise ValueError("more weights than genes")
    pos, line = F.col("POS").cast("bigint"), F.col("CHR") * SPAN + F.col("POS")
    pos = F.when(pos >= SPAN, F.raise_error(F.lit("positions must be below 1,000,000,000")).cast("bigint")).otherwise(pos)
    v = variants.select(F.col(variant_id).alias("variant_id"), F.col("CHR").cast("bigint").alias("CHR"), pos.alias("POS")).withColumn("G", line)
    g = genes.select(F.col("CHR").cast("bigint").alias("CHR"), F.col("POS").cast("bigint").alias("POS"), F.col("gene_idx").cast("bigint").alias("gene_idx")).withColumn("G", line)
    # of genes at one place only the first k can be among a variant's
    at = F.row_number().over(W.partitionBy("G", "CHR").orderBy("gene_idx"))
    places = g.withColumn("_at", at).where(F.col("_at") <= k).groupBy("G", "CHR").agg(F.sort_array(F.collect_list("gene_idx")).alias("ids"))
    positions = v.where("G IS NOT NULL").select("G", "CHR").distinct()
    ranked = running(places.withColumn("n", F.lit(1)).unionByName(positions.withColumns({"ids": F.lit(None).cast("array<bigint>"), "n": F.lit(0)})), F.col("n"), "G", "rank", ties=("n",))
    here = ranked.where("n = 0").select("G", "CHR", F.col("rank").alias("low"), F.floor(F.col("rank") / RUN).alias("run"))
    here = here.join(place_runs(ranked.where("n = 1"), 2 * k), "run")

    def around(reach: int):
        start = F.greatest(F.col("low") - reach, F.lit(0)) - F.col("first")
        return F.slice("places", (start + 1).cast("int"), (F.col("low") + reach - F.col("first") - start).cast("int"))

    def genes_of(reach: int, own: bool):
        kept = F.filter(around(reach), lambda p: p["CHR"] == F.col("CHR")) if own else around(reach)
        far = lambda p: F.when(p["CHR"] == F.col("CHR"), 0).otherwise(1)
        return F.flatten(F.transform(kept, lambda p: F.transform(p["ids"], lambda x: F.struct(far(p).alias("far"), F.abs(p["G"] - F.col("G")).alias("d"), x.alias("gene_idx")))))

    near = here.withColumn("_own", genes_of(k, True))
    near = near.withColumn("_own", F.when(F.size("_own") >= k, F.col("_own")).otherwise(genes_of(2 * k, False)))
    near = near.select("G", F.transform(F.slice(F.array_sort("_own"), 1, k), lambda x: x["gene_idx"]).alias("own"))
    out = v.select("variant_id", "G").join(near, "G").select("variant_id", F.posexplode("own").alias("rank", "gene_idx"))
    return out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") + 1))


def nearest_on_line(variants: DataFrame, genes: DataFrame, weights: tuple[float, ...] = NEAREST_WEIGHTS, variant_id: str = "variant_id") -> DataFrame:
    """``nearest_genes`` by one coordinate POS alone; the rows may be in any order."""
    return nearest_genes(variants.withColumn("CHR", F.lit(1)), genes.withColumn("CHR", F.lit(1)), weights, variant_id)


def genes_by_id(gene: Column) -> Column:
    """Whether a gene is named by its Ensembl id."""
    return gene.contains("ENSG")


def gene_set_annotations(nearest: DataFrame, genes: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """(variant_id, set_name, value): the summed rank weights of a variant's genes in each
    set; a set names genes by id or by symbol.

    ``rows``, about as many as ``nearest`` has, says into how many tasks they are dealt:
    by gene and part, since a gene may be near very many variants, and then by variant,
    in tasks of their own, so that no task sorts and sums at once.
    """
    by_id = genes.select(F.col("gene_id").alias("gene"), "gene_idx")
    by_name = genes.select(F.col("gene_name").alias("gene"), "gene_idx")
    members = sets.join(by_id.unionByName(by_name), "gene").select("set_name", "gene_idx").distinct()
    tasks = n_tasks(nearest.sparkSession, rows)
    part = F.pmod(F.xxhash64("variant_id"), F.lit(GENE_PARTS)).cast("int")
    dealt = nearest.select("variant_id", "gene_idx", "weight", part.alias("_part")).repartition(tasks, "gene_idx", "_part")
    members = members.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(GENE_PARTS - 1))))
    found = dealt.join(members, ["gene_idx", "_part"]).select("variant_id", "set_name", "weight")
    return found.repartition(tasks, "variant_id").groupBy("variant_id", "set_name").agg(F.sum("weight").alias("value"))


def merge_annotations(sumstats: DataFrame, annotations: DataFrame, on: tuple[str, ...] = ("SNP",), keep_unmatched: bool = False) -> DataFrame:
    """Statistics joined to annotations, coordinates from the annotations, the first row of each key."""
    left = sumstats.drop(*[c for c in ("CHR", "POS") if c not in on and c in annotations.columns])
    out = left.join(annotations, list(on), "right" if keep_unmatched else "inner")
    order = [c for c in ("annot_ordinal", "ordinal") if c in out.columns]
    return keep_first(out, list(on), order or list(on))


def restore_rows(rows: DataFrame, marks: DataFrame, ordinal: str = "ordinal", mark: str = "is_index") -> DataFrame:
    """All input rows with a Boolean mark, false where there is none; marks of a row are OR-ed."""
    per = marks.groupBy(ordinal).agg(F.bool_or(mark).alias(mark))
    return rows.join(per, ordinal, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
