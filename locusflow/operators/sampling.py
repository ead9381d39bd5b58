"""Random annotations.  Draws hash the seed with a row's key, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) for every combination of seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def random_gene_sets(genes: DataFrame, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """(set_name, gene): for each name a set of that share of the genes, without replacement."""
    n, out = genes.count(), None
    for k, (name, share) in enumerate(fractions.items()):
        if not 0 <= share <= 1:
            raise ValueError("a share must be in [0, 1]")
        one = genes.orderBy(uniform(seed + k, "gene_id"), "gene_id").limit(round(share * n)).select(F.lit(name).alias("set_name"), F.col("gene_id").alias("gene"))
        out = one if out is None else out.unionByName(one)
    return out


def random_variants(rows: DataFrame, probabilities: dict[str, float], key: str = "RSID", seed: int = 0) -> DataFrame:
    """``rows`` with Boolean columns, each true with its probability."""
    if any(not 0 <= p <= 1 for p in probabilities.values()):
        raise ValueError("a probability must be in [0, 1]")
    return rows.withColumns({name: uniform(seed + k, key) < p for k, (name, p) in enumerate(probabilities.items())})


def perturb(rows: DataFrame, annotations: list[str], fraction: float, key: str = "RSID", seed: int = 0) -> DataFrame:
    """Redraws a fraction of the rows of each binary annotation at its own mean; other annotations go."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction must be in [0, 1]")
    double = {a: F.col(a).cast("double") for a in annotations}
    tests = [F.struct(F.avg(c).alias("mean"), F.count_if(~c.isin(0.0, 1.0)).alias("other"), F.count_if(c.isNull() | F.isnan(c)).alias("gone")).alias(a) for a, c in double.items()]
    found = rows.agg(*tests).first() if tests else {}
    if gone := [a for a in annotations if found[a].gone]:
        raise ValueError(f"missing values in {gone}")
    binary = [a for a in annotations if not found[a].other]
    drawn = {a: F.when(uniform(seed + 2 * k, key) < fraction, (uniform(seed + 2 * k + 1, key) < found[a].mean).cast("double")).otherwise(double[a]) for k, a in enumerate(binary)}
    return rows.drop(*[a for a in annotations if a not in binary]).withColumns(drawn)
