"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Documents get rates r >= 0 closest in relative entropy to 1 (each document
counting by its words) subject to token constraints: for every level k of every
constraint group (say each source, or each language as well), the words taken
must sum to that level's target.  The convex dual has one multiplier per level and
the optimal rates are exponential tilts, r = exp(sum of the multipliers of the
document's levels), at most ``cap``.  Documents with the same levels share a rate, so
Newton's steps run over those cells, which one aggregation of the documents gives.

* One constraint group: the dual falls apart into levels, and each level's Newton steps
  are folded in one expression, without a job of their own.
* Several groups, at most ``LEVELS`` levels in all: a step aggregates the gradient and the
  Hessian (words shared by pairs of levels) over the cells and solves the joint system.
* More levels: one group of multipliers at a time, whose Hessian is diagonal, so that a
  step is an aggregation and a join, and nothing but a few sums reaches the driver.

Rates become whole copies by systematic rounding along the documents of a source in
order of size: the fractional part of r decides how many of each run of documents
get one copy more.  Documents alike in id, source and size are one row with a count
until the end, so repeated rows never gather in a task.  Running sums are taken in two
levels (chunks of bounded size, then the chunks of a source), so no task holds a whole
source.  Then a few rounds each add or drop one copy per source, the one that brings it
closest to its target.  Hash ties are broken by id; nothing depends on partitions, so
reruns agree.

Defined results: null text has size 0; null sources form a source of their own,
last in order; documents of size 0 take 0; an empty table gives no rows; repeated
rows are mixed as separate documents, and which of several alike gets a copy more
doesn't show; null ids are like others; other columns of the input are never read.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import WORD, Scratch, fresh_name, rank_within, table

CAP = 3
#: Levels of several groups whose joint system is solved at once.
LEVELS = 1000
_CHUNK = 4096
_UNIT = 1 << 24
NEWTON_STEPS = 40
FIX_ROUNDS = 6


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_ranks(totals: DataFrame, scratch: Scratch) -> DataFrame:
    """``totals`` with ``rank``, 0 for the first source by code point, null last; sorted by
    ranges, of which only the counts are summed in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = totals.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = scratch.save(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row per range
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return ranged.join(before, "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def capped_targets(totals: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """``totals`` (source, source_size): adds weight (1, 2, 3, repeating by source,
    null last) and target: shares of all sizes by weight, none above ``cap`` times
    its source's size; what is cut off is shared again by weight.

    Only four sums a round reach the driver.
    """
    ranked = scratch.save(source_ranks(totals, scratch).withColumn("weight", ((F.col("rank") % 3) + 1).cast("double")).drop("rank"))
    limit = F.col("source_size") * F.lit(float(cap))
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else (F.col("weight") * F.lit(level) > limit)
        n, size, fixed, weight = ranked.agg(
            F.count_if(over), F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == stopped or weight == 0:
            break
        stopped, level = n, (size - fixed) / weight
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level or 0.0), limit))


def newton_step(gap: Column, curve: Column) -> Column:
    """A Newton step of one multiplier, at most 2 long."""
    return F.when(curve > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / curve))).when(gap < 0, F.lit(-1e-3)).otherwise(0.0)


def level_rates(levels: DataFrame, cap: float = CAP, steps: int = NEWTON_STEPS) -> DataFrame:
    """``levels`` (size, target of each level of a single group) with the level's ``rate``."""
    def step(tilt: Column, _: Column) -> Column:
        taken = F.col("size") * F.least(F.exp(tilt), F.lit(float(cap)))
        curve = F.when(F.exp(tilt) < cap, F.col("size") * F.exp(tilt)).otherwise(0.0)
        return F.greatest(F.lit(-60.0), tilt + newton_step(F.col("target") - taken, curve))

    tilt = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    rate = F.least(F.exp(tilt), F.lit(float(cap)))
    return levels.withColumn("rate", F.when((F.col("target") <= 0) | (F.col("size") <= 0), 0.0).otherwise(rate))


def joint_rates(cells: DataFrame, groups: dict[str, DataFrame], cap: float = CAP, steps: int = NEWTON_STEPS, tolerance: float = 1e-9) -> DataFrame:
    """``newton_rates`` with the joint step: its gradient and Hessian reach the driver, at
    most ``LEVELS`` squared sums."""
    spark = cells.sparkSession
    goal = {(g, r.level): r.target for g, t in groups.items() for r in t.select("level", "target").collect()}
    at = {k: i for i, k in enumerate(goal)}
    target = np.array(list(goal.values()), float)
    tilts = np.where(target > 0, 0.0, -60.0)
    numbered = cells
    for g, t in groups.items():
        known = spark.createDataFrame([(k[1], i) for k, i in at.items() if k[0] == g], t.select("level").schema.add(f"_{g}_at", LongType()))
        numbered = numbered.join(known, numbered[g].eqNullSafe(known["level"]), "left").drop("level")
    places = [F.col(f"_{g}_at") for g in groups]

    def tilt() -> Column:
        listed = F.array(*[F.lit(float(x)) for x in tilts])
        return sum((F.coalesce(F.get(listed, p), F.lit(0.0)) for p in places), F.lit(0.0))

    off = np.inf
    for _ in range(steps):
        rate = F.least(F.exp(tilt()), F.lit(float(cap)))
        free = F.when(F.exp(tilt()) < cap, F.col("size") * F.exp(tilt())).otherwise(0.0)
        pairs = numbered.select((F.col("size") * rate).alias("taken"), free.alias("curve"), F.explode(F.array(*places)).alias("i"), F.array(*places).alias("js")).select("taken", "curve", "i", F.explode("js").alias("j"))
        sums = pairs.where("i IS NOT NULL AND j IS NOT NULL").groupBy("i", "j").agg(F.sum("taken").alias("taken"), F.sum("curve").alias("curve")).collect()
        taken, hessian = np.zeros(len(at)), np.zeros((len(at), len(at)))
        for r in sums:
            hessian[r.i, r.j] = r.curve
            if r.i == r.j:
                taken[r.i] = r.taken
        gap = np.where(target > 0, target - taken, 0.0)
        reachable = (target > 0) & ((np.diag(hessian) > 0) | (gap < 0))
        off = np.max(np.abs(gap[reachable]) / target[reachable], initial=0.0)
        if off < tolerance:
            break
        step, *_ = np.linalg.lstsq(hessian, gap, rcond=1e-12)  # the groups' sums agree, so it is singular
        stuck = (np.diag(hessian) <= 0) & (gap < 0)
        tilts = np.maximum(-60.0, tilts + np.where(stuck, -1e-3, step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))))
    else:
        warnings.warn(f"rates leave constraints unmet by up to {off:.2g} of a target", stacklevel=2)
    return numbered.withColumn("rate", F.least(F.exp(tilt()), F.lit(float(cap)))).drop(*[f"_{g}_at" for g in groups])


def newton_rates(cells: DataFrame, groups: dict[str, DataFrame], scratch: Scratch, cap: float = CAP, steps: int = NEWTON_STEPS, tolerance: float = 1e-9) -> DataFrame:
    """``cells`` (one column per group, size) with the rate of each cell.

    ``groups`` maps a column of ``cells`` to a table (level, target); the levels of
    all groups must be reachable together for the constraints to be met, else there is a
    warning.
    """
    if len(groups) == 1:
        (name, targets), = groups.items()
        levels = cells.groupBy(name).agg(F.sum("size").alias("size")).withColumnRenamed(name, "_of")
        rates = level_rates(levels.join(targets, levels["_of"].eqNullSafe(targets["level"])), cap, steps).select("_of", "rate")
        return cells.join(rates, cells[name].eqNullSafe(rates["_of"])).drop("_of")
    if sum(t.count() for t in groups.values()) <= LEVELS:
        return joint_rates(cells, groups, cap, steps, tolerance)
    return blockwise_rates(cells, groups, scratch, cap, steps, tolerance)


def blockwise_rates(cells: DataFrame, groups: dict[str, DataFrame], scratch: Scratch, cap: float = CAP, steps: int = NEWTON_STEPS, tolerance: float = 1e-9) -> DataFrame:
    """``newton_rates`` for any number of levels, one group of multipliers at a time."""
    state = scratch.save(cells.withColumn("tilt", F.lit(0.0)))
    rate = F.least(F.exp("tilt"), F.lit(float(cap)))
    worst = 0.0
    for _ in range(steps):
        worst = 0.0
        for name, targets in groups.items():
            # dual gradient and (diagonal) Hessian of this block
            sums = state.groupBy(name).agg(F.sum(F.col("size") * rate).alias("taken"), F.sum(F.when(F.exp("tilt") < cap, F.col("size") * F.exp("tilt")).otherwise(0.0)).alias("curve"))
            gap = F.col("target") - F.col("taken")
            moves = sums.withColumnRenamed(name, "level").join(targets.withColumnRenamed("level", "_l"), F.col("level").eqNullSafe(F.col("_l"))).select(
                "level", F.when((F.col("target") <= 0), F.lit(-60.0)).otherwise(newton_step(gap, F.col("curve"))).alias("step"), F.when(F.col("target") > 0, F.abs(gap) / F.col("target")).otherwise(0.0).alias("off"),
                ((F.col("curve") == 0) & (gap > 0)).alias("stuck"))
            after = state.join(moves, state[name].eqNullSafe(moves["level"])).select(*[state[c] for c in state.columns if c != "tilt"], F.greatest(F.lit(-60.0), F.col("tilt") + F.col("step")).alias("tilt"), "off", "stuck")
            after = scratch.save(after)
            worst = max(worst, after.agg(F.max(F.when(~F.col("stuck"), F.col("off")))).first()[0] or 0.0)
            scratch.drop(state)
            state = after.drop("off", "stuck")
            state._scratch_path = after._scratch_path
        if worst < tolerance:
            break
    else:
        warnings.warn(f"rates leave constraints unmet by up to {worst:.2g} of a target", stacklevel=2)
    return state.withColumn("rate", rate)


def round_copies(rated: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """``rated`` (doc_id, source, size, n alike, rate): adds ``copies`` of all n together,
    whole numbers whose sum over any run of documents of about one size follows that of
    the rates."""
    whole = F.least(F.floor("rate"), F.lit(cap))
    part = F.when(F.col("rate") >= cap, F.lit(0)).otherwise(F.floor((F.col("rate") - F.floor("rate")) * _UNIT)).cast("long") * F.col("n")
    part = rated.withColumn("copies", (whole * F.col("n")).cast("long")).withColumn("part", part)
    part = part.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 16).cast("int")).withColumn("mark", F.xxhash64("doc_id"))
    key = ["source", "class"]
    cells = part.groupBy(*key).agg(F.count("*").alias("_n")).select(F.col("source").alias("_s"), F.col("class").alias("_c"), F.ceil(F.col("_n") / _CHUNK).alias("n_chunks"))
    part = part.join(cells, part["source"].eqNullSafe(F.col("_s")) & (part["class"] == F.col("_c"))).drop("_s", "_c")
    part = scratch.save(part.withColumn("chunk", F.pmod(F.col("mark"), F.col("n_chunks"))).drop("n_chunks"))
    chunks = part.groupBy("source", "class", "chunk").agg(F.sum("part").alias("inside"))
    before = chunks.select(
        F.col("source").alias("_s"), F.col("class").alias("_c"), F.col("chunk").alias("_k"),
        (F.sum("inside").over(W.partitionBy("source").orderBy("class", "chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("inside")).alias("start"))
    joined = part.join(before, part["source"].eqNullSafe(F.col("_s")) & (part["class"] == F.col("_c")) & (part["chunk"] == F.col("_k"))).drop("_s", "_c", "_k")
    upto = F.col("start") + F.sum("part").over(W.partitionBy("source", "class", "chunk").orderBy("size", "mark", "doc_id").rowsBetween(W.unboundedPreceding, 0)) + F.lit(_UNIT // 2)
    more = F.floor(upto / _UNIT) - F.floor((upto - F.col("part")) / _UNIT)
    return joined.withColumn("copies", F.least(F.col("copies") + more, F.lit(cap) * F.col("n")).cast("long")).drop("part", "class", "chunk", "start")


def settle(copied: DataFrame, targets: DataFrame, scratch: Scratch, cap: int = CAP, rounds: int = FIX_ROUNDS) -> DataFrame:
    """Each round changes, for every source, one copy of one document (a document changes
    once): the one that brings its taken words closest to its target, if one does."""
    base = scratch.save(copied)
    gaps = base.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    gaps = scratch.save(gaps.join(targets.select(F.col("source").alias("_s"), "target"), gaps["source"].eqNullSafe(F.col("_s"))).select(F.col("source").alias("_g"), (F.col("target") - F.col("taken")).alias("gap")))
    key = ["source", "size", "doc_id"]
    moved = None
    alike = lambda a, b: a["source"].eqNullSafe(b["_source"]) & (a["size"] == b["_size"]) & a["doc_id"].eqNullSafe(b["_doc_id"])
    for _ in range(rounds):
        left = base if moved is None else base.join(moved, alike(base, moved), "left_anti")
        step = F.when((F.col("gap") > 0) & (F.col("copies") < cap * F.col("n")), F.lit(1)).when((F.col("gap") < 0) & (F.col("copies") > 0), F.lit(-1)).otherwise(0)
        options = left.join(gaps, left["source"].eqNullSafe(F.col("_g"))).withColumn("step", step).withColumn("left", F.abs(F.col("gap") - F.col("step") * F.col("size")))
        best = options.where((F.col("step") != 0) & (F.col("left") < F.abs("gap"))).groupBy("source").agg(F.min(F.struct("left", "mark", "doc_id", "size", "step")).alias("best"))
        best = scratch.save(best.select(F.col("source").alias("_source"), F.col("best.size").alias("_size"), F.col("best.doc_id").alias("_doc_id"), F.col("best.step").alias("_step")))
        if best.isEmpty():
            break
        moved = best if moved is None else scratch.save(moved.unionByName(best))
        gaps = scratch.save(gaps.join(best, F.col("_g").eqNullSafe(F.col("_source")), "left").select("_g", (F.col("gap") - F.coalesce(F.col("_step") * F.col("_size"), F.lit(0))).alias("gap")))
    if moved is None:
        return base
    after = base.join(moved, alike(base, moved), "left").withColumn("copies", F.col("copies") + F.coalesce("_step", F.lit(0)))
    return after.select(*[c for c in base.columns if c not in key and c != "copies"], *[base[c] for c in key], "copies")


def mixed_kinds(docs: DataFrame, scratch: Scratch, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, n, source_size, target, rate, copies): ``copies`` of the n
    documents alike in id, source and size together, 0 to ``cap`` times n."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    kinds = scratch.save(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    totals = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = scratch.save(capped_targets(totals, scratch, cap))
    cells = targets.select("source", F.col("source_size").cast("double").alias("size"))
    rates = newton_rates(cells, {"source": targets.select(F.col("source").alias("level"), "target")}, scratch, cap)
    rates = rates.select(F.col("source").alias("_s"), "rate")
    rated = kinds.join(rates, kinds["source"].eqNullSafe(F.col("_s"))).drop("_s")
    copied = settle(round_copies(rated, scratch, cap), targets, scratch, cap)
    goal = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return copied.join(goal, copied["source"].eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "n", "source_size", "target", "rate", "copies")


def copies_of(rank: Column) -> Column:
    """Copies of the document of this rank (from 0) among the n alike."""
    return F.floor(F.col("copies") / F.col("n")) + (rank < F.col("copies") % F.col("n")).cast("long")


def mix_sources(docs: DataFrame, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every document."""
    scratch = Scratch(docs.sparkSession)
    kinds = scratch.save(mixed_kinds(docs, scratch, cap, id_col, text_col, source_col))
    # documents alike are spelled out again, many of them in runs that are dealt anew
    runs = kinds.where("n > 1").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _CHUNK)))).hint("rebalance")
    several = runs.withColumn("rank", F.explode(F.sequence(F.col("run") * _CHUNK, F.least((F.col("run") + 1) * _CHUNK, F.col("n")) - 1))).drop("run")
    each = kinds.where("n = 1").withColumn("rank", F.lit(0).cast("long")).unionByName(several).withColumn("copies", copies_of(F.col("rank")))
    return each.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (its repeats carry the same id)."""
    scratch = Scratch(spark)
    kinds = scratch.save(mixed_kinds(docs, scratch).where("copies > 0").select(F.struct("doc_id", "source", "size", "n", "copies").alias("kind")))
    # the same plan at every size: a sort-merge join
    like = docs.join(kinds.hint("merge"), docs["doc_id"].eqNullSafe(kinds["kind"]["doc_id"]) & docs["source"].eqNullSafe(kinds["kind"]["source"]) & (word_count(docs["text"]) == kinds["kind"]["size"]))
    kind, rank, copy = (fresh_name(docs.columns, x) for x in ("kind", "rank", "copy"))
    like = scratch.save(like.select(*[docs[c] for c in docs.columns], kinds["kind"].alias(kind)))
    single = like.where(F.col(kind)["n"] == 1).withColumn(rank, F.lit(0).cast("long"))
    several = rank_within(like.where(F.col(kind)["n"] > 1), [kind], rank, scratch)
    n, total = F.col(kind)["n"], F.col(kind)["copies"]
    times = F.floor(total / n) + (F.col(rank) < total % n).cast("long")
    both = single.unionByName(several).where(times > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)
