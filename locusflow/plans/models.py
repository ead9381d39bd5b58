"""Per-block models.  Spark matches variants, packs one row per block and runs each
block as a stateless function; totals over blocks are DataFrame aggregations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.links import Link, named
from ..functions.numeric import log10_two_sided
from ..operators.joins import active_indices, merge_snplists, restore_rows
from .precision import Block, likelihood_gradient, likelihood_hessian, log_likelihood


#: Blocks of so many indices are dense whatever their entries: one call inverts them sooner than
#: loops over the columns of a sparse factor do, and their matrix is 512 kB.
SMALL = 256


def pack_edges(edges: DataFrame) -> DataFrame:
    """(edge_block, i, j, v, n): one row of arrays per block; a block's matrix fits one task by design."""
    e = F.sort_array(F.collect_list(F.struct("i", "j", "value")))
    packed = edges.groupBy("block_id").agg(e.alias("e"), F.max(F.greatest("i", "j")).alias("top"))
    return packed.select(F.col("block_id").alias("edge_block"), F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.value").alias("v"), (F.col("top") + 1).alias("n"))


def per_block(rows: DataFrame, edges: DataFrame, schema: str, solve: Callable[[pd.DataFrame, Block], pd.DataFrame]) -> DataFrame:
    """Runs ``solve(rows of a block by ordinal, its matrix)`` for every block that has rows.
    A block is one row of arrays on both sides, so a task takes many of them in one batch."""
    columns = ["ordinal", *[c for c in rows.columns if c not in ("block_id", "ordinal")]]
    held = rows.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_r"))
    held = held.select("block_id", *[F.col("_r")[c].alias(f"_r{k}") for k, c in enumerate(columns)])
    both = held.join(pack_edges(edges).withColumnRenamed("edge_block", "block_id"), "block_id")

    def run(batches):
        for pdf in batches:
            found = []
            for block, *arrays, i, j, v, n in pdf.itertuples(index=False, name=None):
                order = np.zeros(0, np.int64) if n <= SMALL else None
                found.append(solve(pd.DataFrame({"block_id": block, **dict(zip(columns, arrays, strict=True))}), Block.from_entries(i, j, v, int(n), order)))
            if found := [f for f in found if len(f)]:
                yield pd.concat(found, ignore_index=True)

    return both.mapInPandas(run, schema)


def matched(variants: DataFrame, sumstats: DataFrame, z: str = "Z", **how) -> DataFrame:
    """Matched variants with phased Z and their active index; rows without a finite Z are left out."""
    good = sumstats.where(F.col(z).isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf")))
    return active_indices(merge_snplists(variants, good, add_allelic=(z,), **how))


def blup(variants: DataFrame, sumstats: DataFrame, edges: DataFrame, heritability: float, sample_size: float, **how) -> DataFrame:
    """``sumstats`` rows in blocks with ``weight``: sqrt(n) s2 (P + n s2 I)^-1 P z, s2 = h2 / matched indices."""
    if not 0 <= heritability <= 1:
        raise ValueError("heritability must be in [0, 1]")
    rows = matched(variants, sumstats, **how).where("is_representative = 1")
    m = rows.select("block_id", "index").distinct().count()
    if m == 0:
        raise ValueError("no variant matches")
    s2, n = heritability / m, sample_size

    def solve(r: pd.DataFrame, block: Block) -> pd.DataFrame:
        r = r.sort_values("index")
        p = block[r["index"].to_numpy()]
        u = p.multiply(r["Z"].to_numpy())
        # inverse of (Schur complement + n s2 I), which adds to the selected diagonal
        w = np.sqrt(n) * s2 * p.plus_diagonal(n * s2).solve(u)
        return pd.DataFrame({"block_id": r["block_id"], "ordinal": r["stats_ordinal"], "weight": w})

    out = per_block(rows.select("block_id", "index", "ordinal", "stats_ordinal", "Z"), edges, "block_id long, ordinal long, weight double", solve)
    return sumstats.join(out, ["block_id", "ordinal"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def greedy_clump(z: np.ndarray, r: np.ndarray | Callable[[int], np.ndarray], min_chisq: float, max_rsq: float) -> np.ndarray:
    """Index variants in descending chi-square, each pruning its correlates; ``r`` is the
    correlation matrix or a function that gives a row, which is asked for index variants only."""
    row = r if callable(r) else r.__getitem__
    chisq, lead, pruned = z * z, np.zeros(len(z), bool), np.zeros(len(z), bool)
    for i in np.argsort(-chisq, kind="stable"):
        if chisq[i] < min_chisq:
            break
        if not pruned[i]:
            lead[i] = True
            pruned |= row(i) ** 2 >= max_rsq
    return lead


def clump(variants: DataFrame, sumstats: DataFrame, edges: DataFrame, rows: DataFrame, max_rsq: float = 0.1, min_chisq: float = 30.0, **how) -> DataFrame:
    """All input ``rows`` (ordinal, ...) with ``is_index``; ``sumstats`` are those rows in blocks."""
    found = matched(variants, sumstats, **how).where("is_representative = 1")

    def solve(r: pd.DataFrame, block: Block) -> pd.DataFrame:
        r = r.sort_values("index")
        lead = greedy_clump(r["Z"].to_numpy(), block[r["index"].to_numpy()].correlation_row(), min_chisq, max_rsq)
        return pd.DataFrame({"ordinal": r["stats_ordinal"], "is_index": lead})

    marks = per_block(found.select("block_id", "index", "ordinal", "stats_ordinal", "Z"), edges, "ordinal long, is_index boolean", solve)
    return restore_rows(rows, marks)


def closest(block: Block, index: np.ndarray, have: np.ndarray, some: int = 128) -> np.ndarray:
    """For each index the one of ``have`` with the largest squared correlation, the first on ties."""
    parts = [have[np.argmax(block.correlations(index[k: k + some])[:, have] ** 2, axis=1)] for k in range(0, len(index), some)]
    return np.concatenate(parts) if parts else index


def surrogates(variants: DataFrame, sumstats: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """(block_id, index, surrogate_index) of every index: itself if matched, else the matched
    index with the largest squared correlation, the first on ties; itself without any."""
    found = merge_snplists(variants, sumstats, **how).select("block_id", "index").distinct().withColumn("matched", F.lit(True))
    every = variants.groupBy("block_id", "index").agg(F.min("ordinal").alias("ordinal")).join(found, ["block_id", "index"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))

    def solve(r: pd.DataFrame, block: Block) -> pd.DataFrame:
        index, have = r["index"].to_numpy(), np.sort(r.loc[r["matched"], "index"].to_numpy())
        out = index.copy()
        if len(have):
            gone = np.flatnonzero(~r["matched"].to_numpy(bool))
            out[gone] = closest(block, index[gone], have)
        return pd.DataFrame({"block_id": r["block_id"], "index": index, "surrogate_index": out})

    return per_block(every, edges, "block_id long, index int, surrogate_index int", solve)


def block_likelihoods(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(block_id, ll): the Gaussian log-likelihood of the rows' ``pz`` (premultiplied by the
    precision) at their indices, for covariance-inverse ``edges``."""
    def solve(r: pd.DataFrame, block: Block) -> pd.DataFrame:
        r = r.sort_values("index")
        return pd.DataFrame({"block_id": [r["block_id"].iloc[0]], "ll": [log_likelihood(r["pz"].to_numpy(float), block[r["index"].to_numpy()])]})

    return per_block(rows.select("block_id", "ordinal", "index", "pz"), edges, "block_id long, ll double", solve)


def variant_solve(rows: DataFrame, edges: DataFrame, value: str = "b") -> DataFrame:
    """(block_id, ordinal, x): the correlation matrix times ``value`` by variant: values of
    variants at one index are added, solved for, and each takes its index's result."""
    def solve(r: pd.DataFrame, block: Block) -> pd.DataFrame:
        return pd.DataFrame({"block_id": r["block_id"], "ordinal": r["ordinal"], "x": block.variant_solve(r["value"].to_numpy(float), r["index"].to_numpy())})

    return per_block(rows.select("block_id", "ordinal", "index", F.col(value).alias("value")), edges, "block_id long, ordinal long, x double", solve)


@dataclass
class RemlOptions:
    sample_size: float
    intercept: float = 1.0
    denominator: float = 6e6
    iterations: int = 50
    tolerance: float = 0.01
    window: int = 3
    trust: float = 1e-1
    trust_factor: float = 5.0
    trust_steps: int = 20
    reset_trust: bool = False
    trials: int = 4
    groups: int = 100
    link: str | Link = "softplus"
    trace: str = "exact"
    samples: int = 100
    seed: int = 0

    def __post_init__(self):
        if self.iterations < 1:
            raise ValueError("at least one iteration is needed")
        if self.trace not in ("exact", "hutchinson", "xdiag"):
            raise ValueError("the trace estimator is exact, hutchinson or xdiag")
        self.link = named(self.link)  # goes to the executors with the options


_PACKED = "block_id long, n int, i array<int>, j array<int>, v array<double>, order array<int>, selected array<int>, rest double, pz array<double>, row array<long>, index array<int>, a array<double>"


def reml_blocks(variants: DataFrame, sumstats: DataFrame, edges: DataFrame, annotations: list[str], options: RemlOptions, surrogate_map: DataFrame | None = None, **how) -> DataFrame:
    """One packed row per block, computed once: the scaled matrix's entries and an elimination
    order, the active indices, Pz, each matched row's ordinal, active index and annotations,
    and the block's jackknife group ``jk``.

    A row without a finite Z stands at its surrogate of ``surrogate_map`` (block_id, index,
    surrogate_index), if that has a value, else at the index with the largest squared correlation.
    """
    merged = merge_snplists(variants, sumstats, add_allelic=("Z",), add=tuple(annotations), **how)
    k = len(annotations)
    if surrogate_map is None:
        merged = merged.withColumn("surrogate_index", F.col("index"))
    else:
        merged = merged.join(surrogate_map.select("block_id", "index", "surrogate_index"), ["block_id", "index"], "left").withColumn("surrogate_index", F.coalesce("surrogate_index", "index"))
    names = [c.split(" ")[0] for c in _PACKED.split(", ")]

    def solve(r: pd.DataFrame, block: Block) -> pd.DataFrame:
        z = r["Z"].to_numpy(float)
        seen = np.isfinite(z)
        if not seen.any():
            return pd.DataFrame(columns=names)
        index = np.where(seen, r["index"].to_numpy(), r["surrogate_index"].to_numpy())
        have = np.unique(index[seen])
        lost = np.flatnonzero(~seen & ~np.isin(index, have))
        index[lost] = closest(block, index[lost], have)
        first = np.unique(r["index"].to_numpy()[seen], return_index=True)[1]
        p = block[have].scaled(options.intercept / options.sample_size)
        pz = p.multiply(z[seen][first]) * (options.sample_size / options.intercept) / np.sqrt(options.sample_size)
        i, j, v, order = p.entries()
        row = [r["block_id"].iloc[0], p.size, i, j, v, order, have, p.rest_logdet(), pz, r["ordinal"].to_numpy(np.int64), np.searchsorted(have, index).astype(np.int32), r[annotations].to_numpy(float).ravel()]
        return pd.DataFrame({name: [x] for name, x in zip(names, row, strict=True)})

    cols = ["block_id", "index", "surrogate_index", "ordinal", "Z", *annotations]
    packed = per_block(merged.select(*cols), edges, _PACKED, solve).withColumn("k", F.lit(k))
    return packed


def with_groups(packed: DataFrame, groups: int) -> DataFrame:
    """Packed rows of one or more traits with their jackknife group: blocks in order, in runs
    of equal length (the first ones a block longer).  Only (trait, block) is ranked."""
    packed = packed if "trait" in packed.columns else packed.withColumn("trait", F.lit(""))
    w = W.partitionBy("trait")
    at, n = F.row_number().over(w.orderBy("block_id")) - 1, F.count("*").over(w)
    ranked = packed.select("trait", "block_id").select("trait", "block_id", at.alias("_at"), n.alias("_n"))
    each = F.expr(f"_n div least({int(groups)}, _n)")
    wide = F.expr(f"(_n % least({int(groups)}, _n))") * (each + 1)
    jk = F.when(F.col("_at") < wide, F.floor(F.col("_at") / (each + 1))).otherwise(F.expr(f"_n % least({int(groups)}, _n)") + F.floor((F.col("_at") - wide) / each))
    return packed.join(ranked.select("trait", "block_id", jk.cast("int").alias("jk")), ["trait", "block_id"])


def _block_of(r) -> Block:
    return Block.from_entries(r.i, r.j, r.v, int(r.n), np.asarray(r.order, np.int64))[np.asarray(r.selected, np.int64)]


def _terms(r, theta: np.ndarray, options: RemlOptions, derivatives: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Likelihood of a packed block at ``theta``, and its gradient and Hessian if wanted."""
    a, index, pz = np.asarray(r.a, float).reshape(-1, len(theta)), np.asarray(r.index), np.asarray(r.pz, float)
    value, slope, _ = options.link.arrays(a @ theta)
    m = _block_of(r).plus_diagonal(np.bincount(index, value / options.denominator, len(pz)))
    m.known_rest_logdet = float(r.rest)
    ll = float(log_likelihood(pz, m))
    if not derivatives:
        return ll, np.zeros(0), np.zeros((0, 0))
    jac = np.zeros((len(pz), len(theta)))
    np.add.at(jac, index, (slope / options.denominator)[:, None] * a)
    seed = None if options.trace == "exact" else (options.seed * 1_000_003 + int(r.block_id)) % (1 << 32)
    return ll, likelihood_gradient(pz, m, jac, options.trace, options.samples, seed), likelihood_hessian(pz, m, jac)


_USED = ["block_id", "n", "i", "j", "v", "order", "selected", "rest", "pz", "index", "a"]


def evaluate(blocks: DataFrame, theta: np.ndarray, options: RemlOptions, derivatives: bool = True) -> DataFrame:
    """(block_id, ll, g, h): likelihood, gradient and Hessian of every block."""
    def run(batches):
        for pdf in batches:
            rows = [(int(r.block_id), *_terms(r, theta, options, derivatives)) for r in pdf.itertuples()]
            yield pd.DataFrame([(b, ll, g, h.ravel()) for b, ll, g, h in rows], columns=["block_id", "ll", "g", "h"])

    return blocks.select(*_USED).mapInPandas(run, "block_id long, ll double, g array<double>, h array<double>")


def totals(blocks: DataFrame, trials: dict[str, list[np.ndarray]], options: dict[str, RemlOptions], derivatives: bool) -> DataFrame:
    """(trait, trial, jk, x): likelihood, gradient and Hessian, one behind the other, summed by
    jackknife group (by trait alone without derivatives) at each trial's parameters.

    Tasks sum their blocks before anything leaves them, and the numbers are added up by
    place, so however many blocks there are, a group is one row of p² + p + 1 numbers.
    """
    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                for t, theta in enumerate(trials[r.trait]):
                    ll, g, h = _terms(r, theta, options[r.trait], derivatives)
                    key, x = (r.trait, t, int(r.jk) if derivatives else 0), np.concatenate([[ll], g, h.ravel()])
                    sums[key] = sums[key] + x if key in sums else x
        yield pd.DataFrame([(*key, x) for key, x in sums.items()], columns=["trait", "trial", "jk", "x"])

    running = blocks.where(F.col("trait").isin(list(trials))).select("trait", "jk", *_USED)
    parts = running.mapInPandas(run, "trait string, trial int, jk int, x array<double>")
    summed = parts.select("trait", "trial", "jk", F.posexplode("x").alias("place", "x")).groupBy("trait", "trial", "jk", "place").agg(F.sum("x").alias("x"))
    return summed.groupBy("trait", "trial", "jk").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("x"))


@dataclass
class GroupSum:
    """A jackknife group's likelihood, gradient and Hessian."""

    jk: int
    ll: float
    g: np.ndarray
    h: np.ndarray


def group_sums(blocks: DataFrame, thetas: dict[str, np.ndarray], options: dict[str, RemlOptions]) -> dict[str, list[GroupSum]]:
    """Per trait its groups' sums, in order: at most ``groups`` rows of p² + p + 1 numbers each."""
    out: dict[str, list[GroupSum]] = {t: [] for t in thetas}
    for r in totals(blocks, {t: [x] for t, x in thetas.items()}, options, True).orderBy("trait", "jk").collect():
        x, k = np.array(r.x), len(thetas[r.trait])
        out[r.trait].append(GroupSum(r.jk, float(x[0]), x[1: 1 + k], x[1 + k:].reshape(k, k)))
    return out


def likelihoods(blocks: DataFrame, trials: dict[str, list[np.ndarray]], options: dict[str, RemlOptions]) -> dict[str, list[float]]:
    """Per trait the likelihood at each trial's parameters, all in one job."""
    out = {t: [0.0] * len(x) for t, x in trials.items()}
    for r in totals(blocks, trials, options, False).collect():  # a row per trait and trial
        out[r.trait][r.trial] = float(r.x[0])
    return out


def _variant_scores(theta: np.ndarray, options: RemlOptions, hessian: bool, with_annotations: bool):
    k = len(theta)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a, index, pz = np.asarray(r.a, float).reshape(-1, k), np.asarray(r.index), np.asarray(r.pz, float)
                value, slope, curve = (x / options.denominator for x in options.link.arrays(a @ theta))
                m = _block_of(r).plus_diagonal(np.bincount(index, value, len(pz)))
                m.known_rest_logdet = float(r.rest)
                node = likelihood_gradient(pz, m)[index]
                out = {"block_id": int(r.block_id), "ordinal": np.asarray(r.row), "gradient": node * slope}
                if hessian:
                    out["hessian"] = likelihood_hessian(pz, m)[index] * slope**2 + node * curve
                if with_annotations:
                    out["a"] = list(a)
                yield pd.DataFrame(out)
    return run


def variant_scores(blocks: DataFrame, theta: np.ndarray, options: RemlOptions, hessian: bool = False, with_annotations: bool = False) -> DataFrame:
    """(block_id, ordinal, gradient and, if wanted, hessian and annotations ``a``): first and
    second derivative of the log-likelihood by each variant's argument of the link."""
    schema = "block_id long, ordinal long, gradient double" + (", hessian double" if hessian else "") + (", a array<double>" if with_annotations else "")
    return blocks.select(*_USED, "row").mapInPandas(_variant_scores(theta, options, hessian, with_annotations), schema)


def without_annotations(scored: DataFrame, k: int, y: str = "gradient") -> DataFrame:
    """Takes the least-squares part of ``a`` (``k`` annotations a row) out of ``y``.  Tasks return
    X'X and X'y, which are added up by place; the coefficients are literals of k numbers."""
    def run(batches):
        moments = np.zeros((k, k + 1))
        for pdf in batches:
            if len(pdf):
                a = np.stack(pdf["a"].to_numpy())
                moments += a.T @ np.column_stack([a, pdf["y"].to_numpy(float)])
        yield pd.DataFrame({"x": [moments.ravel()]})

    parts = scored.select("a", F.col(y).alias("y")).mapInPandas(run, "x array<double>")
    sums = parts.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    moments = np.array([r.x for r in sums]).reshape(k, k + 1)
    beta = np.linalg.lstsq(moments[:, :k], moments[:, k], rcond=None)[0]
    fitted = F.aggregate(F.zip_with("a", F.array(*[F.lit(float(b)) for b in beta]), lambda x, b: x * b), F.lit(0.0), lambda t, x: t + x)
    return scored.withColumn(y, F.col(y) - fitted)


def write_scores(store, trait: str, blocks: DataFrame, variants: DataFrame, fit: dict, annotations: list[str], options: RemlOptions, hessian: bool = False) -> None:
    """A trait's variant scores, with the model's annotations projected out, and parameters into
    a score store, which is made if there is none; the rows of an existing one must be the
    same.  ``blocks`` are the trait's."""
    scored = variant_scores(blocks, fit["theta"], options, hessian, with_annotations=True).dropDuplicates(["ordinal"])
    scored = without_annotations(scored, len(annotations)).drop("a")
    place = variants.select("ordinal", *[F.col(c) for c in ("CHR",) if c in variants.columns], F.col("position").alias("POS"), F.col("site_ids").alias("RSID"))
    group = blocks.select("block_id", F.col("jk").cast("long").alias("jackknife_blocks"))
    rows = scored.select("block_id", "ordinal").join(place, "ordinal").join(group, "block_id").drop("block_id")
    try:
        store.rows()
    except FileNotFoundError:
        store.create(rows, "variant", ["RSID"])
    else:
        store.validate_rows(rows)
    store.write_trait(trait, scored.drop("block_id"), parameters=(annotations, list(fit["theta"])))


def trust_region_step(g: np.ndarray, h: np.ndarray, trust: float) -> tuple[np.ndarray, float]:
    """Step of (H + trust * diag(H)) s = -g, and the increase it predicts."""
    s = np.linalg.lstsq(h + trust * np.diag(np.diag(h) - 1e-12), -g, rcond=None)[0]
    return s, float(s @ g + 0.5 * s @ h @ s)


class _Fit:
    """One trait's fit between two jobs."""

    def __init__(self, theta: np.ndarray, options: RemlOptions):
        self.theta, self.o = theta, options
        self.trust, self.history, self.converged, self.ended = options.trust, [], False, False
        self.groups: list[GroupSum] = []

    def begin(self, groups: list[GroupSum]) -> None:
        self.groups, self.ll = groups, sum(x.ll for x in groups)
        self.g, self.h = sum(x.g for x in groups), sum(x.h for x in groups)
        self.history = self.history or [self.ll]
        self.trust = self.o.trust if self.o.reset_trust else self.trust
        self.tried, self.searching = 0, True

    def proposals(self) -> list[tuple[np.ndarray, float, float]]:
        """The next trust values with their steps, as many as one job tries at once."""
        out, trust = [], self.trust
        for _ in range(min(self.o.trials, self.o.trust_steps - self.tried)):
            out.append((*trust_region_step(self.g, self.h, trust), trust))
            trust = max(self.o.trust, trust * self.o.trust_factor)
        return out

    def choose(self, proposals: list, after: list[float]) -> None:
        """What trying them one after the other would have done."""
        for (step, predicted, trust), ll in zip(proposals, after, strict=True):
            self.trust, self.tried = trust, self.tried + 1
            rho = (ll - self.ll) / predicted if predicted > 0 else -1.0
            if rho >= 1e-4:
                self.theta, self.ll = self.theta + step, ll
                self.trust = trust / self.o.trust_factor if rho > 0.99 else trust
                self.searching = False
                return
            if predicted < 1e-6 or trust > 1e12:
                self.searching = False
                return
        self.trust = max(self.o.trust, self.trust * self.o.trust_factor)
        self.searching = self.tried < self.o.trust_steps

    def finish(self) -> None:
        self.history.append(self.ll)
        w = self.o.window
        if len(self.history) >= w and abs(self.history[-1] - self.history[-w]) < w * self.o.tolerance:
            self.converged = True
        self.ended = self.converged or len(self.history) > self.o.iterations


def fit_traits(blocks: DataFrame, starts: dict[str, np.ndarray], options: dict[str, RemlOptions]) -> dict[str, dict]:
    """Trust-region Newton on the blockwise likelihoods of all traits in step: a job evaluates
    every trait that still runs, each at its own parameters, and a job tries several trust
    values of each.  ``blocks`` have columns trait and jk (``with_groups``)."""
    fits = {t: _Fit(np.array(x, float), options[t]) for t, x in starts.items()}
    while running := {t: f for t, f in fits.items() if not f.ended}:
        for t, groups in group_sums(blocks, {t: f.theta for t, f in running.items()}, options).items():
            running[t].begin(groups)
        while searching := {t: f.proposals() for t, f in running.items() if f.searching}:
            found = likelihoods(blocks, {t: [running[t].theta + p[0] for p in ps] for t, ps in searching.items()}, options)
            for t, ps in searching.items():
                running[t].choose(ps, found[t])
        for f in running.values():
            f.finish()
    return {t: {"theta": f.theta, "likelihood": f.history, "converged": f.converged, "blocks": f.groups} for t, f in fits.items()}


def fit_reml(blocks: DataFrame, annotations: list[str], options: RemlOptions, start: np.ndarray | None = None) -> dict:
    """``fit_traits`` of one trait."""
    theta = np.zeros(len(annotations)) if start is None else np.array(start, float)
    return fit_traits(blocks if "jk" in blocks.columns else with_groups(blocks, options.groups), {"": theta}, {"": options})[""]


def jackknife_thetas(theta: np.ndarray, blocks: list, groups: int) -> np.ndarray:
    """One Newton step from theta with each group of blocks (or of group sums) left out.

    The log-likelihood is concave near its maximum (H is negative), so the step that goes
    uphill subtracts H^-1 g.
    """
    k, n = len(theta), len(blocks)
    g, h = np.array([b.g for b in blocks]), np.array([np.array(b.h).reshape(k, k) for b in blocks])
    parts = np.array_split(np.arange(n), min(groups, n))
    return np.array([theta - np.linalg.lstsq(h.sum(0) - h[p].sum(0) - 1e-12 * np.eye(k), g.sum(0) - g[p].sum(0), rcond=None)[0] for p in parts])


def wald_log10_p(values: np.ndarray) -> float:
    """log10 two-sided p of jackknife values against 0; 0 if they don't vary."""
    n = len(values)
    se = np.sqrt((n - 1) * values.var(ddof=1)) if n > 1 else 0.0
    return log10_two_sided(values.mean() / se) if se > 0 else 0.0


def heritability_at(rows: DataFrame, annotations: list[str], thetas: np.ndarray, denominator: float, link: str | Link = "softplus") -> tuple[np.ndarray, np.ndarray]:
    """Per parameter vector and annotation the sum of h2 times annotation, and the annotation
    sizes.  Tasks return one partial sum each; nothing is multiplied by the vectors' number."""
    t, k, value = np.atleast_2d(thetas), len(annotations), named(link).arrays

    def run(batches):
        h2, size = np.zeros((len(t), k)), np.zeros(k)
        for pdf in batches:
            a = pdf.to_numpy(float)
            h2 += (value(a @ t.T)[0] / denominator).T @ a
            size += a.sum(axis=0)
        yield pd.DataFrame({"h2": [h2.ravel()], "size": [size]})

    parts = rows.select(*[F.col(a).cast("double").alias(a) for a in annotations]).mapInPandas(run, "h2 array<double>, size array<double>")
    sums = parts.select(F.posexplode(F.concat("h2", "size")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    found = np.array([r.x for r in sums])
    return found[:-k].reshape(len(t), k), found[-k:]


def reml_report(rows: DataFrame, annotations: list[str], fit: dict, options: RemlOptions) -> pd.DataFrame:
    """Per annotation the parameter, heritability and enrichment, each with its jackknife
    standard error and log10 p.  The p of an enrichment tests the difference of the
    heritability per unit from that of the first annotation; its error is the quotient's."""
    thetas = jackknife_thetas(fit["theta"], fit["blocks"], options.groups)
    h2, size = heritability_at(rows, annotations, np.vstack([fit["theta"], thetas]), options.denominator, options.link)
    per = h2 / size
    quotient, difference = per / per[:, :1], per - per[:, :1]
    n = len(thetas)
    se = lambda v: np.sqrt((n - 1) * v.var(axis=0, ddof=1)) if n > 1 else np.full(len(annotations), np.nan)
    out = {"annotation": annotations, "parameter": fit["theta"], "parameter_se": se(thetas), "parameter_log10p": [wald_log10_p(v) for v in thetas.T]}
    out |= {"heritability": h2[0], "heritability_se": se(h2[1:]), "heritability_log10p": [wald_log10_p(v) for v in h2[1:].T]}
    out |= {"enrichment": quotient[0], "enrichment_se": se(quotient[1:]), "enrichment_log10p": [wald_log10_p(v) for v in difference[1:].T]}
    return pd.DataFrame(out)
