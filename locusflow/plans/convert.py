"""A variant-level score store converted to a gene-level one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import genes_from_variants
from ..operators.joins import NEAREST_WEIGHTS, nearest_genes
from ..sources.store import ScoreStore


def convert_store(variants: ScoreStore, target: ScoreStore, genes: DataFrame, weights: tuple[float, ...] = NEAREST_WEIGHTS) -> None:
    """Gradients of every trait scattered to the nearest genes; groups stay.  The nearest
    genes are found once for all traits."""
    if variants.meta()[0] != "variant":
        raise ValueError("the store is not at variant level")
    rows = variants.rows().withColumn("variant_id", F.col("ordinal"))
    nearest = nearest_genes(rows, genes, weights).persist()
    made = False
    for trait in variants.traits():
        scored = variants.load_trait(trait).select(F.col("ordinal").alias("variant_id"), F.col("gradient").alias("grad"), F.col("jackknife_blocks").alias("jk"))
        out = genes_from_variants(nearest, scored, genes)
        if not made:
            target.create(out.select("gene_idx", "jk").join(genes, "gene_idx").select(F.col("gene_idx").alias("ordinal"), "gene_id", "gene_name", "CHR", "POS", F.col("jk").alias("jackknife_blocks")), "gene", ["gene_id"])
            made = True
        target.write_trait(trait, out.select(F.col("gene_idx").alias("ordinal"), "gradient"))
    nearest.unpersist()
    if groups := variants.groups():
        target.write_groups(groups)
