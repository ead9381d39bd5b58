"""Aggregations: score tests, jackknives, meta-analysis, gene scatter, projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import is_finite
from .joins import small
from .sweep import running


def with_runs(df: DataFrame, column: str, order: str = "ordinal", name: str = "run", chunks: int = 1 << 16) -> DataFrame:
    """Numbers the runs of equal neighbours of ``column`` in row order, from 0.

    Changes are found inside ranges of ``chunks`` rows, with the last value of the range
    before carried over, and counted by a sweep.
    """
    edges = df.select(F.col(order).alias("_o"), F.col(column).alias("_v")).where((F.col(order) + 1) % chunks == 0).select((F.col("_o") + 1).alias("_next"), F.struct("_v").alias("_last"))
    w = W.partitionBy("_part").orderBy(order)
    out = df.withColumn("_part", F.floor(F.col(order) / chunks)).join(edges, df[order] == F.col("_next"), "left").drop("_next")
    before = F.coalesce(F.lag(F.struct(F.col(column).alias("_v"))).over(w), F.col("_last"))
    out = out.withColumn("_new", F.when(before.isNull(), F.when(F.col(order) == 0, 0).otherwise(1)).when(before["_v"].eqNullSafe(F.col(column)), 0).otherwise(1)).drop("_last", "_part")
    return running(out, F.col("_new"), order, name, inclusive=True).withColumn(name, F.col(name).cast("long")).drop("_new")


def score_statistics(long: DataFrame, keys: tuple[str, ...] = ("annot",), block: str = "jk", gradient: str = "grad", value: str = "a") -> DataFrame:
    """Per block and annotation the sum of gradient times annotation, and the leave-one-out sum."""
    per = long.groupBy(*keys, block).agg(F.sum(F.col(gradient) * F.col(value)).alias("u"))
    total = per.groupBy(*keys).agg(F.sum("u").alias("u_total"))
    return per.join(total, list(keys)).withColumn("u_loo", F.col("u_total") - F.col("u"))


def score_z(stats: DataFrame, keys: tuple[str, ...] = ("annot",), blocks: int | None = None) -> DataFrame:
    """Z = U / (population deviation of the leave-one-out sums * sqrt(B - 1))."""
    n = F.lit(blocks) if blocks else F.count("*")
    return stats.groupBy(*keys).agg(F.max("u_total").alias("u"), F.stddev_pop("u_loo").alias("sd"), n.alias("b")).withColumn(
        "z", F.col("u") / F.nullif(F.col("sd") * F.sqrt(F.col("b") - 1), F.lit(0.0))).drop("sd", "b")


def score_test(rows: DataFrame, annotations: list[str], block: str = "jk", gradient: str = "grad") -> DataFrame:
    """(annot, u, z) of wide rows: annotations are unpivoted inside one scan; a block that
    an annotation misses still counts, its sum is 0."""
    pairs = F.array(*[F.struct(F.lit(a).alias("annot"), F.col(a).cast("double").alias("a")) for a in annotations])
    long = rows.select(block, gradient, F.explode(pairs).alias("p")).select(F.col(block).alias("jk"), F.col(gradient).alias("grad"), "p.annot", "p.a")
    return score_z(score_statistics(long))


def meta_analysis(stats: DataFrame, groups: DataFrame, keys: tuple[str, ...] = ("annot",), block: str = "jk") -> DataFrame:
    """(group, annot, z): traits of a group combined with weights 1 / population variance
    of their leave-one-out sums.  ``stats`` has a column trait, ``groups`` (group, trait)."""
    per = stats.groupBy("trait", *keys).agg((1 / F.nullif(F.var_pop("u_loo"), F.lit(0.0))).alias("w"))
    joined = stats.join(per, ["trait", *keys]).join(small(groups), "trait")
    combined = joined.groupBy("group", *keys, block).agg(F.sum(F.col("w") * F.col("u_loo")).alias("u_loo"), F.sum(F.col("w") * F.col("u_total")).alias("u_total"))
    return score_z(combined, ("group", *keys))


def offsets(df: DataFrame, n: str, order: str, name: str = "offset") -> DataFrame:
    """Adds the sum of ``n`` over all rows before, in order."""
    return running(df, F.col(n), order, name)


def rms_z(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, rms): the root mean square of the finite values of each column of Z."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("z")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.name", F.when(is_finite(F.col("p.z")), F.col("p.z")).alias("z"))
    return long.groupBy("name").agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("rms"))


def nonzero_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n): how many values of each column are neither 0 nor missing."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.name").agg(F.count_if((F.col("p.x") != 0) & ~F.isnan("p.x")).alias("n"))


def chisq_summary(df: DataFrame, keys: tuple[str, ...] = (), z: str = "Z", n: str = "N") -> DataFrame:
    """The largest N, and number, mean and largest of the finite squared Z, of each key."""
    square = F.when(is_finite(F.col(z)), F.col(z) * F.col(z))
    return df.groupBy(*keys).agg(F.max(n).alias("max_n"), F.count(square).alias("n_variants"), F.avg(square).alias("mean_chisq"), F.max(square).alias("max_chisq"))


def jackknife_se(values: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """sqrt((n - 1) * sample variance) of jackknife values."""
    return values.groupBy(*keys).agg(F.sqrt((F.count("*") - 1) * F.var_samp(value)).alias("se"))


def genes_from_variants(nearest: DataFrame, variants: DataFrame, genes: DataFrame) -> DataFrame:
    """Variant scores carried over to genes: (gene_idx, gradient, jk).

    A gene's gradient sums weight * gradient over its variants (0 without any).  Its
    jackknife block is that of the last block whose first variant's nearest gene comes
    no later, carried along the genes by a sweep.  Gene and block sums come from one
    aggregation of the variants' genes, so these are found once.
    """
    first = variants.groupBy(F.col("jk").alias("_jk")).agg(F.min("variant_id").alias("variant_id"))
    rows = nearest.join(variants.select("variant_id", "grad").join(first, "variant_id", "left"), "variant_id")
    starts = F.max(F.when(F.col("rank") == 0, F.col("_jk")))
    scored = rows.groupBy("gene_idx").agg(F.sum(F.col("weight") * F.col("grad")).alias("gradient"), starts.alias("_start"))
    out = genes.select("gene_idx").join(scored, "gene_idx", "left")
    at = F.when(F.col("_start").isNotNull(), F.struct(F.col("gene_idx").alias("_at"), F.col("_start").alias("_block")))
    out = running(out, at, "gene_idx", "_last", "max", inclusive=True)
    return out.select("gene_idx", F.coalesce("gradient", F.lit(0.0)).alias("gradient"), F.coalesce("_last._block", F.lit(0)).alias("jk"))


def project_out(rows: DataFrame, y: str, columns: list[str], name: str | None = None) -> DataFrame:
    """Takes the columns' least-squares part out of ``y``: moments in one aggregation, a
    small solve on the driver, the coefficients as literals."""
    p = len(columns)
    moments = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]] + [F.sum(F.col(a) * F.col(y)) for a in columns]
    found = list(rows.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first())
    x = np.zeros((p, p))
    x[np.triu_indices(p)] = [v or 0.0 for v in found[: p * (p + 1) // 2]]
    x = x + np.triu(x, 1).T
    beta = np.linalg.lstsq(x, np.array([v or 0.0 for v in found[p * (p + 1) // 2:]]), rcond=None)[0]
    fitted = sum((F.col(c) * float(b) for c, b in zip(columns, beta, strict=True)), F.lit(0.0))
    return rows.withColumn(name or y, F.col(y) - fitted)


def sample_size(df: DataFrame, n: str = "N", how: str = "mean") -> float:
    """Mean of the finite positive N (1.0 without any), or their median."""
    good = F.when(is_finite(F.col(n)) & (F.col(n) > 0), F.col(n))
    return df.agg(F.avg(good) if how == "mean" else F.median(good)).first()[0] or 1.0


def drop_extreme_blocks(variants: DataFrame, limit: float, z: str = "Z") -> DataFrame:
    """Leaves out blocks whose largest finite squared Z exceeds ``limit``; all gone raises."""
    top = F.max(F.when(is_finite(F.col(z)), F.col(z) * F.col(z)))
    kept = variants.groupBy("block_id").agg(top.alias("top")).where(F.coalesce(F.col("top") <= limit, F.lit(True)))
    if kept.isEmpty():
        raise ValueError("every block exceeds the limit")
    return variants.join(kept.select("block_id"), "block_id", "left_semi")


def annotation_heritability(rows: DataFrame, annotations: list[str], h2: str = "h2") -> DataFrame:
    """(annot, h2, size, enrichment): enrichment is against the first annotation."""
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(a).alias("annot"), F.col(a).cast("double").alias("a")) for i, a in enumerate(annotations)])
    sums = rows.select(h2, F.explode(pairs).alias("p")).groupBy("p.k", "p.annot").agg(F.sum(F.col("p.a") * F.col(h2)).alias("h2"), F.sum("p.a").alias("size"))
    base = sums.where("k = 0").select(F.col("h2").alias("_h"), F.col("size").alias("_s"))
    out = sums.join(F.broadcast(base))
    return out.select("annot", "h2", "size", ((F.col("h2") / F.nullif("size", F.lit(0.0))) / F.nullif(F.col("_h") / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0))).alias("enrichment"))
