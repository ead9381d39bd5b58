"""Score tests of sparse annotations: entries (row key, annot, value) that aren't 0.

Annotations stay entries from the reader to the sums, so thousands of gene sets cost
their members and not a column each.  A block in which an annotation has no entry has
the sum 0; such blocks are put back by their number alone, in the deviation of the
leave-one-out sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import n_tasks
from .sampling import uniform

#: One entry in so many tells how entries are dealt, and from how many on an annotation's are summed by block first.
SAMPLED, MANY = 1000, 100_000


def entries(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, annot, value) of the values of ``names`` that are neither 0 nor missing; the
    rest is left out inside the scan."""
    pairs = F.array(*[F.struct(F.lit(a).alias("annot"), F.col(a).cast("double").alias("value")) for a in names])
    there = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != 0))
    return wide.select(*keys, F.explode(there).alias("_p")).select(*keys, "_p.annot", "_p.value")


def _sizes(found: DataFrame, on: list[str]) -> tuple[int, list]:
    """About how many entries there are, and the annotations with more than about ``MANY``,
    by one entry in ``SAMPLED``.  They only say how entries are dealt."""
    drawn = found.where(F.pmod(F.xxhash64(*on, "annot"), F.lit(SAMPLED)) == 0).groupBy("annot").agg(F.count("*").alias("n"))
    total, large = drawn.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_list(F.when(F.col("n") * SAMPLED > MANY, F.col("annot")))).first()
    return total * SAMPLED, large


def _summed(rows: DataFrame, found: DataFrame, on: list[str], by: tuple[str, ...], block: str, gradients: list[str]) -> DataFrame:
    """(by, annot, block, gradients): each gradient's sum of gradient times value.

    Entries are dealt by annotation, into tasks of bounded size, so what is summed by
    annotation afterwards is where it belongs.  Annotations of very many entries are
    summed by block first, as blocks are fewer than entries then.
    """
    spark = found.sparkSession
    total, large = _sizes(found, on)
    tasks = n_tasks(spark, total)

    def sums(part: DataFrame, dealt: bool) -> DataFrame:
        joined = rows.select(*on, *by, block, *gradients).join(part.select(*on, "annot", "value"), on)
        joined = joined.select(*by, "annot", block, *[(F.col(g) * F.col("value")).alias(g) for g in gradients])
        joined = joined.repartition(tasks, "annot") if dealt else joined
        return joined.groupBy(*by, "annot", block).agg(*[F.sum(g).alias(g) for g in gradients])

    if not large:
        return sums(found, True)
    marks = F.broadcast(spark.createDataFrame([(a,) for a in large], found.select("annot").schema))
    return sums(found.join(marks, "annot", "left_anti"), True).unionByName(sums(found.join(marks, "annot", "left_semi"), False))


def block_sums(rows: DataFrame, found: DataFrame, on: list[str], by: tuple[str, ...] = (), block: str = "jk", gradient: str = "grad") -> DataFrame:
    """(by, annot, block, u): the sum of gradient times value, of the blocks with an entry."""
    return _summed(rows, found, on, by, block, [gradient]).withColumnRenamed(gradient, "u")


def trait_sums(rows: DataFrame, found: DataFrame, on: list[str], traits: list[str], block: str = "jk") -> DataFrame:
    """(trait, annot, block, u) for traits whose gradients are columns of ``rows``: entries are
    joined and dealt once for all of them, and sums become a row per trait where they are."""
    sums = _summed(rows, found, on, (), block, traits)
    each = F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("u")) for t in traits])
    return sums.select("annot", block, F.explode(each).alias("_t")).select("_t.trait", "annot", block, "_t.u")


def n_blocks(rows: DataFrame, by: tuple[str, ...] = (), block: str = "jk") -> DataFrame:
    """(by, blocks): how many blocks there are, with entries or without."""
    return rows.groupBy(*by, block).agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count("*").alias("blocks"))


def _spread(u: str, blocks, over=lambda x: x):
    """Population deviation of ``u`` over all blocks, those without a row counting as 0."""
    n, mean = over(F.count(u)), over(F.avg(u))
    within = F.coalesce(over(F.var_pop(u)) * n, F.lit(0.0))
    return F.sqrt((within + mean * mean * n * (blocks - n) / blocks) / blocks)


def score_z(sums: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, annot, u, b, z) like the dense test: Z = U / (deviation of the leave-one-out sums
    * sqrt(B - 1)), which vary as the blocks' sums do."""
    if by:
        joined, b = sums.join(F.broadcast(blocks), list(by)), F.first("blocks")  # a row per trait or group
    else:
        joined, b = sums, F.lit(blocks.first().blocks)  # one number
    out = joined.groupBy(*by, "annot").agg(F.sum("u").alias("u"), _spread("u", b).alias("sd"), b.alias("b"))
    return out.withColumn("z", F.col("u") / F.nullif(F.col("sd") * F.sqrt(F.col("b") - 1), F.lit(0.0))).drop("sd")


def meta_z(sums: DataFrame, blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, annot, z): a group's traits with weights 1 / variance of their block sums.
    ``sums`` have a column trait, ``groups`` are (group, trait); a group's blocks are those
    of its traits, which share them."""
    own = W.partitionBy("trait", "annot")
    weighed = sums.join(F.broadcast(blocks), "trait").withColumn("sd", _spread("u", F.col("blocks"), lambda x: x.over(own))).drop("blocks")
    weighed = weighed.withColumn("w", 1 / F.nullif(F.col("sd") * F.col("sd"), F.lit(0.0)))
    joined = weighed.join(F.broadcast(groups), "trait")
    combined = joined.groupBy("group", "annot", "jk").agg(F.sum(F.col("w") * F.col("u")).alias("u"))
    most = blocks.join(groups, "trait").groupBy("group").agg(F.max("blocks").alias("blocks"))
    return score_z(combined, most, ("group",)).select("group", "annot", "z")


def with_all(z: DataFrame, every: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows also for annotations that have no entry anywhere: u = 0 and no z."""
    whole = every
    if by:
        found = z.select(*by).distinct().collect()  # a row per trait or group
        names = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in by]) for r in found])
        whole = every.select("annot", F.explode(names).alias("_k")).select("annot", *[f"_k.{c}" for c in by]) if found else z.select("annot", *by)
    out = whole.join(z, [*by, "annot"], "left")
    return out.withColumn("u", F.coalesce("u", F.lit(0.0))) if "u" in out.columns else out


def random_entries(rows: DataFrame, keys: list[str], probabilities: dict[str, float], key: str = "RSID", seed: int = 0) -> DataFrame:
    """Entries of random annotations, each with its probability per row; only hits leave the scan."""
    if any(not 0 <= p <= 1 for p in probabilities.values()):
        raise ValueError("a probability must be in [0, 1]")
    drawn = [F.when(uniform(seed + k, key) < p, F.lit(name)) for k, (name, p) in enumerate(probabilities.items())]
    return rows.select(*keys, F.explode(F.filter(F.array(*drawn), lambda x: x.isNotNull())).alias("annot"), F.lit(1.0).alias("value"))


def perturbed(rows: DataFrame, found: DataFrame, keys: list[str], fraction: float, key: str = "RSID", seed: int = 0) -> DataFrame:
    """Redraws a fraction of the rows of each annotation of 0 and 1 at its own mean; others go.

    A row's draws depend on (seed, key, annotation).  Entries drawn again leave; new ones
    are drawn row by row from the names and means, and only hits leave the scan.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction must be in [0, 1]")
    n = rows.count()
    means = {r.annot: r.n / n for r in found.groupBy("annot").agg(F.count("*").alias("n"), F.count_if(F.col("value") != 1).alias("other")).where("other = 0").collect()}  # a row per annotation
    if not means:
        return found.where("false")
    table = F.array(*[F.struct(F.lit(a).alias("annot"), F.lit(m).alias("mean")) for a, m in sorted(means.items())])
    draw = lambda s, annot: F.pmod(F.xxhash64(F.lit(s), F.col(key), annot), F.lit(1 << 53)) / float(1 << 53)
    hit = F.filter(table, lambda t: (draw(2 * seed, t["annot"]) < fraction) & (draw(2 * seed + 1, t["annot"]) < t["mean"]))
    fresh = rows.select(*keys, F.explode(hit).alias("_t")).select(*keys, F.col("_t.annot").alias("annot"), F.lit(1.0).alias("value"))
    binary = found.sparkSession.createDataFrame([(a,) for a in means], "annot string")
    kept = found.join(binary, "annot").where(draw(2 * seed, F.col("annot")) >= fraction)
    return kept.select(*keys, "annot", "value").unionByName(fresh)
