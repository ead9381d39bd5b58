"""Sparse factors, links, sums on executors, sweeps and sparse annotations against plain forms."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions import links
from locusflow.operators import aggregates as A
from locusflow.operators import joins as J
from locusflow.operators import sparse as S
from locusflow.operators.sweep import running
from locusflow.plans import models as M
from locusflow.plans.precision import Block, likelihood_gradient, likelihood_hessian, log_likelihood
from locusflow.plans.sparse_block import SparseBlock, least_degree_order
from locusflow.sources import store


def random_block(rng, n, share):
    """(i, j, v) of one triangle, with repeated entries and either orientation."""
    i, j = np.nonzero(np.tril(rng.random((n, n)) < share, -1))
    turn = rng.random(len(i)) < 0.5
    i, j = np.where(turn, j, i), np.where(turn, i, j)
    v = rng.normal(size=len(i))
    i, j, v = np.append(i, i[:3]), np.append(j, j[:3]), np.append(v, v[:3] / 2)
    full = np.zeros((n, n))
    np.add.at(full, (i, j), v)
    np.add.at(full, (j, i), v)
    own = np.abs(full).sum(axis=1) + rng.uniform(0.5, 2, n)
    return np.append(i, np.arange(n)), np.append(j, np.arange(n)), np.append(v, own), full + np.diag(own)


@pytest.mark.parametrize("seed, n, share", [(1, 40, 0.05), (2, 120, 0.02), (3, 60, 0.0), (4, 1, 0.0), (5, 200, 0.012)])
def test_sparse_blocks_equal_dense_ones(seed, n, share):
    rng = np.random.default_rng(seed)
    i, j, v, full = random_block(rng, n, share)
    sparse = Block.from_entries(i, j, v, n)
    assert isinstance(sparse, SparseBlock)
    keep = np.flatnonzero(rng.random(n) < 0.6) if n > 1 else np.array([0])
    a, b = sparse[keep], Block(full)[keep]
    x, wide = rng.normal(size=len(keep)), rng.normal(size=(len(keep), 3))
    for f in ("solve", "multiply"):
        assert np.allclose(getattr(a, f)(x), getattr(b, f)(x)) and np.allclose(getattr(a, f)(wide), getattr(b, f)(wide))
    assert np.isclose(a.logdet(), b.logdet()) and np.allclose(a.inverse_diagonal(), b.inverse_diagonal())
    d = rng.uniform(0.1, 1, len(keep))
    a2, b2 = a.plus_diagonal(d), b.plus_diagonal(d)
    a2.known_rest_logdet = a.rest_logdet()
    assert np.isclose(log_likelihood(x, a2), log_likelihood(x, b2))
    assert np.allclose(likelihood_gradient(x, a2, wide), likelihood_gradient(x, b2, wide)) and np.allclose(likelihood_hessian(x, a2, wide), likelihood_hessian(x, b2, wide))
    assert np.allclose(a.correlations(np.arange(len(keep))), b.correlation()) and np.allclose(a.scaled(2.0).diagonal(), 2 * b.diagonal())
    again = Block.from_entries(*a.entries()[:3], n, a.entries()[3])
    assert np.allclose(again[keep].solve(x), a.solve(x)) and sum(map(len, again.graph.columns)) <= n * (n - 1) / 2


def test_order_keeps_fill_low_and_gives_up_on_dense_blocks():
    n = 200
    star = np.zeros(n - 1, np.int64), np.arange(1, n)
    order = least_degree_order(n, *star)
    assert sum(map(len, SparseBlock(__import__("locusflow.plans.sparse_block", fromlist=["Graph"]).Graph(n, *star, order), np.ones(n - 1), np.full(n, 300.0)).graph.columns)) == n - 1
    i, j = np.tril_indices(60, -1)
    assert least_degree_order(60, i, j, 300) is None
    assert not isinstance(Block.from_entries(np.append(i, range(60)), np.append(j, range(60)), np.append(np.full(len(i), 0.01), np.ones(60)), 60), SparseBlock)


def test_draws_have_the_inverse_as_covariance():
    rng = np.random.default_rng(7)
    i, j, v, full = random_block(rng, 12, 0.1)
    block = Block.from_entries(i, j, v, 12)
    x = np.array([block.draw(rng) for _ in range(20000)])
    assert np.allclose(x.T @ x / len(x), np.linalg.inv(full), atol=0.03)


def test_warm_conjugate_gradients_take_fewer_steps():
    rng = np.random.default_rng(8)
    i, j, v, full = random_block(rng, 150, 0.02)
    block = Block.from_entries(i, j, v, 150)
    b, near = rng.normal(size=(150, 5)), block.plus_diagonal(rng.uniform(0, 0.2, 150))
    cold, steps = near.solve_iteratively(b)
    warm, fewer = near.solve_iteratively(b, like=block, start=block.solve(b))
    assert np.allclose(cold, near.solve(b), atol=1e-6) and np.allclose(warm, near.solve(b), atol=1e-6) and fewer < steps


def test_one_factor_for_all_probes_of_xdiag():
    from locusflow.plans.precision import xdiag

    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 40))
    a = np.linalg.inv(a @ a.T + np.eye(40))
    w = rng.choice([-1.0, 1.0], size=(40, 8))
    y, one = a @ w, np.zeros(40)
    for k in range(8):
        q, _ = np.linalg.qr(np.delete(y, k, axis=1))
        one += (q * (a @ q)).sum(axis=1) + w[:, k] * (y[:, k] - q @ (q.T @ y[:, k]))
    assert np.allclose(xdiag(w, y, lambda x: a @ x), one / 8)
    twice = np.column_stack([w, w[:, 0]])
    assert np.isfinite(xdiag(twice, a @ twice, lambda x: a @ x)).all()


def test_links(spark):
    for name in ("softplus", "exponential"):
        links.check(links.named(name), spark)
    square = links.Link("square", lambda x: (x * x, 2 * x, F.lit(2.0)), lambda x: (x * x, 2 * x, np.full(np.shape(x), 2.0)))
    links.check(square, spark)
    with pytest.raises(ValueError, match="first"):
        links.register(links.Link("wrong", square.columns, lambda x: (x * x, x, np.ones(np.shape(x)))))
    with pytest.raises(ValueError, match="second"):
        links.register(links.Link("wrong", square.columns, lambda x: (x * x, 2 * x, x)))
    with pytest.raises(ValueError, match="column form"):
        links.register(links.Link("wrong", lambda x: (x, x, x), square.arrays), spark)
    with pytest.raises(ValueError, match="no link"):
        M.RemlOptions(1.0, link="wrong")


@pytest.fixture(scope="module")
def tables(spark):
    from locusflow.plans.catalog import ordered_blocks

    return ordered_blocks(spark, "/root/testdata/sf0.001", 0.8)


NAMES = ["base", "urgent"]


def packed(tables, options, trait="", z=1.0):
    lists, stats, edges = tables
    stats = stats.where("ordinal % 11 <> 3").withColumn("Z", F.col("Z") * z)
    return M.reml_blocks(lists, stats, edges, NAMES, options).withColumn("trait", F.lit(trait))


def test_two_traits_fit_as_two_fits(spark, tables):
    o = M.RemlOptions(sample_size=1000.0, denominator=1000.0, iterations=3, groups=4)
    p = M.RemlOptions(sample_size=500.0, denominator=800.0, iterations=6, groups=4)
    a, b = packed(tables, o, "a"), packed(tables, p, "b", -1.7)
    both = M.with_groups(a.unionByName(b), 4).persist()
    sc = spark.sparkContext

    def jobs(f):
        sc.setJobGroup("count", "")
        out = f()
        return out, len(sc.statusTracker().getJobIdsForGroup("count"))

    fits, together = jobs(lambda: M.fit_traits(both, {"a": [0.0, 0.0], "b": [0.0, 0.0]}, {"a": o, "b": p}))
    first, alone_a = jobs(lambda: M.fit_reml(a.drop("trait"), NAMES, o))
    second, alone_b = jobs(lambda: M.fit_reml(b.drop("trait"), NAMES, p))
    assert np.allclose(fits["a"]["theta"], first["theta"]) and np.allclose(fits["b"]["theta"], second["theta"])
    assert fits["a"]["likelihood"] == pytest.approx(first["likelihood"]) and len(fits["a"]["blocks"]) <= 4
    assert together <= max(alone_a, alone_b) + 4
    sc.setJobGroup("", "")


def test_sums_are_those_of_the_blocks(tables):
    o = M.RemlOptions(sample_size=1000.0, denominator=1000.0, groups=3)
    blocks = M.with_groups(packed(tables, o), 3).persist()
    theta = np.array([0.3, -0.2])
    rows = M.evaluate(blocks, theta, o).orderBy("block_id").collect()
    groups = M.group_sums(blocks, {"": theta}, {"": o})[""]
    parts = np.array_split(np.arange(len(rows)), 3)
    assert len(groups) == 3
    for g, part in zip(groups, parts, strict=True):
        assert g.ll == pytest.approx(sum(rows[k].ll for k in part)) and np.allclose(g.g, sum(np.array(rows[k].g) for k in part)) and np.allclose(g.h.ravel(), sum(np.array(rows[k].h) for k in part))
    got = M.likelihoods(blocks, {"": [theta, theta + 0.1]}, {"": o})[""]
    assert got[0] == pytest.approx(sum(r.ll for r in rows)) and got[1] == pytest.approx(sum(r.ll for r in M.evaluate(blocks, theta + 0.1, o, False).collect()))


def test_trust_values_tried_together_choose_as_one_by_one():
    """A steep function makes the first steps fail; what is chosen doesn't depend on how many are tried at once."""
    f = lambda x: -np.cosh(4 * x[0]) + x[0]

    def path(trials, **more):
        fit, out = M._Fit(np.array([1.5]), M.RemlOptions(1.0, trials=trials, trust=1e-3, **more)), []
        for _ in range(6):
            x = fit.theta
            fit.begin([M.GroupSum(0, f(x), np.array([-4 * np.sinh(4 * x[0]) + 1]), np.array([[-3.0]]))])
            while fit.searching:
                p = fit.proposals()
                assert len(p) <= trials
                fit.choose(p, [f(fit.theta + s) for s, _, _ in p])
            fit.finish()
            out.append((float(fit.theta[0]), fit.trust, fit.tried))
        return out

    assert path(1) == path(3) == path(7) and path(1)[-1][0] < 1.5
    assert max(n for _, _, n in path(3, reset_trust=True)) > 2 and path(2, trust_steps=3)[0] == (1.5, path(1, trust_steps=3)[0][1], 3)


def test_trace_estimates_are_near_the_exact_gradient(tables):
    o = M.RemlOptions(sample_size=1000.0, denominator=1000.0)
    e = M.RemlOptions(sample_size=1000.0, denominator=1000.0, trace="hutchinson", samples=600, seed=3)
    blocks = packed(tables, o).persist()
    exact, near = (M.evaluate(blocks, np.zeros(2), x).orderBy("block_id").collect() for x in (o, e))
    assert np.allclose([r.g for r in near], [r.g for r in exact], atol=0.02 * np.abs([r.g for r in exact]).max())
    assert [r.g for r in M.evaluate(blocks, np.zeros(2), e).orderBy("block_id").collect()] == [r.g for r in near]


def test_running_sums_and_maxima(spark):
    rng = np.random.default_rng(1)
    at = np.sort(rng.choice(np.array([3, 4, 70_000, 70_001, 1 << 20, 1 << 33, (1 << 33) + 5, 1 << 50, -9, -(1 << 40)]), 60))
    rows = [(int(a), k, int(rng.integers(0, 9))) for k, a in enumerate(at)]
    df = spark.createDataFrame(rows, "at long, k long, x long")
    got = running(running(df, F.col("x"), "at", "s", ties=("k",)), F.col("x"), "at", "m", "max", ties=("k",), inclusive=True).orderBy("k").collect()
    x = [r[2] for r in rows]
    assert [r.s for r in got] == [sum(x[:k]) for k in range(len(x))] and [r.m for r in got] == [max(x[: k + 1]) for k in range(len(x))]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_genes_by_brute_force(spark, seed):
    """Crowded places, ties, chromosomes with few genes and with none."""
    rng = np.random.default_rng(seed)
    genes = [(k, int(rng.choice([1, 1, 1, 2, 3, 5])), int(rng.choice([10, 10, 20, 500, 1000, 5000]) + rng.integers(0, 3)), f"g{k}") for k in range(400)]
    variants = [(k, int(rng.integers(1, 7)), int(rng.choice([1, 10, 11, 700, 5001, 10**8]))) for k in range(300)]
    g = spark.createDataFrame([x[:3] for x in genes], "gene_idx long, CHR long, POS long")
    v = spark.createDataFrame(variants, "variant_id long, CHR long, POS long")
    plan = J.nearest_genes(v, g)
    got = {}
    for r in plan.orderBy("variant_id", "rank").collect():
        got.setdefault(r.variant_id, []).append(r.gene_idx)
    for k, c, p in variants:
        want = sorted((0 if gc == c else 1, abs(gp - p) if gc == c else abs(gc * 10**9 + gp - c * 10**9 - p), i) for i, gc, gp, _ in genes)[:7]
        assert got[k] == [i for _, _, i in want]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in text


def plans_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sweeps_have_no_nested_loop_and_no_keyless_window(spark):
    from locusflow.plans import catalog

    for name in ("q_knn_genes", "q_nearest_on_line", "q_gene_scatter", "q_runs", "q_block_offsets", "q_merge_intervals"):
        plan = plans_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan, name


def test_sparse_tests_equal_dense_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k // 10, float(rng.normal()), *(float(x) for x in (rng.random(3) < 0.1))) for k in range(200)]
    wide = spark.createDataFrame(rows, "ordinal long, jk long, grad double, a double, b double, c double")
    wide = wide.withColumn("none", F.lit(0.0)).withColumn("some", F.when(F.col("ordinal") == 3, 2.5).otherwise(F.lit(None)))
    names = ["a", "b", "c", "none", "some"]
    found = S.entries(wide, ["ordinal"], names)
    assert found.count() == sum(sum(r[3:]) for r in rows) + 1
    every = spark.createDataFrame([(n,) for n in names], "annot string")
    got = {r.annot: r for r in S.with_all(S.score_z(S.block_sums(wide, found, ["ordinal"]), S.n_blocks(wide)), every).collect()}
    want = {r.annot: r for r in A.score_test(wide.fillna(0.0), names).collect()}
    for n in names:
        assert got[n].u == pytest.approx(want[n].u) and (got[n].z == pytest.approx(want[n].z) if want[n].z is not None else got[n].z is None)
    plan = plans_of(S.score_z(S.block_sums(wide, found, ["ordinal"]), S.n_blocks(wide)))
    assert "pivot" not in plan.lower()


def test_perturbed_entries_keep_their_mean(spark):
    rows = spark.range(4000).select(F.col("id").alias("ordinal"), F.concat(F.lit("rs"), "id").alias("RSID"))
    found = rows.where("ordinal % 4 = 0").select("ordinal", "RSID", F.lit("a").alias("annot"), F.lit(1.0).alias("value")).unionByName(rows.select("ordinal", "RSID", F.lit("b").alias("annot"), F.lit(0.5).alias("value")))
    got = S.perturbed(rows, found, ["ordinal"], 0.5, seed=2)
    kept = {r.ordinal for r in got.collect()}
    assert {r.annot for r in got.select("annot").distinct().collect()} == {"a"} and 880 < len(kept) < 1120 and 400 < len([k for k in kept if k % 4 == 0]) < 800
    assert {r.ordinal for r in S.perturbed(rows.repartition(7), found.repartition(5), ["ordinal"], 0.5, seed=2).collect()} == kept
    assert {r.ordinal for r in S.perturbed(rows, found, ["ordinal"], 0.0).collect()} == set(range(0, 4000, 4))


def test_a_map_of_other_blocks_is_refused(spark, tmp_path):
    blocks = spark.createDataFrame([(0, "x", "EUR"), (1, "y", "EUR")], "block_id long, name string, population string")
    v = spark.createDataFrame([(0, 0, "a", 5, "A", "C"), (0, 1, "b", 6, "A", "G"), (1, 0, "c", 7, "T", "C")], "block_id long, index int, site_ids string, position long, anc_alleles string, deriv_alleles string")
    prints = store.block_fingerprints(v, blocks)
    map_ = v.select(F.when(F.col("block_id") == 0, "x").otherwise("y").alias("block_name"), "index", F.col("index").alias("surrogate_index"))
    path = str(tmp_path / "map")
    store.write_surrogates(map_, path, prints)
    assert store.read_surrogate_map(spark, path, store.block_fingerprints(v.repartition(3), blocks)).count() == 3
    others = [store.block_fingerprints(v.where("site_ids <> 'b'"), blocks), store.block_fingerprints(v, blocks.withColumn("population", F.lit("AFR"))), store.block_fingerprints(v, blocks.withColumn("name", F.concat("name", F.lit("2"))))]
    others.append(store.block_fingerprints(v.withColumn("deriv_alleles", F.lit("T")), blocks))
    for other in others:
        with pytest.raises(ValueError, match="other blocks"):
            store.read_surrogate_map(spark, path, other)
    store.write_surrogates(map_, str(tmp_path / "bare"))
    with pytest.raises(ValueError, match="fingerprints"):
        store.read_surrogate_map(spark, str(tmp_path / "bare"), prints)


def test_tasks_of_set_sums_grow_with_the_entries(spark, monkeypatch):
    """Lines by order, then entries by set, are dealt by their number and not by the session's."""
    from locusflow.plans import catalog

    monkeypatch.setattr(J, "TASK_ROWS", 500)
    monkeypatch.setattr(S, "SAMPLED", 1)
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    entries = lines.select("l_orderkey", "l_partkey").distinct().count()
    plan = plans_of(catalog.QUERIES["q_sparse_sets"](spark, d))
    for key, n in (("rid", lines.count()), ("annot", entries)):
        assert set(re.findall(rf"hashpartitioning\({key}#\d+L, (\d+)\), REPARTITION", plan)) == {str(-(-n // 500))}, key


@pytest.mark.parametrize("many", [0, 30, 10**9])
def test_sums_of_large_annotations_equal_dense_ones(spark, monkeypatch, many):
    """All, one or none of the annotations are summed by block first; several traits at once or one by one."""
    monkeypatch.setattr(S, "SAMPLED", 1)
    monkeypatch.setattr(S, "MANY", many)
    rng = np.random.default_rng(5)
    rows = [(k, k // 10, float(rng.normal()), float(rng.normal()), 1.0, float(k % 9 == 0), float(k == 7)) for k in range(200)]
    wide = spark.createDataFrame(rows, "ordinal long, jk long, t1 double, t2 double, a double, b double, c double")
    found = S.entries(wide, ["ordinal"], ["a", "b", "c"])
    sums = S.trait_sums(wide, found, ["ordinal"], ["t1", "t2"]).collect()
    assert len(sums) == len({(r.trait, r.annot, r.jk) for r in sums}) == 2 * (20 + len({k // 10 for k in range(0, 200, 9)}) + 1)
    for t, g in (("t1", 2), ("t2", 3)):
        single = {(r.annot, r.jk): r.u for r in S.block_sums(wide, found, ["ordinal"], gradient=t).collect()}
        for r in sums:
            if r.trait == t:
                want = sum(x[g] * x[4 + "abc".index(r.annot)] for x in rows if x[1] == r.jk)
                assert r.u == pytest.approx(want) and single[r.annot, r.jk] == pytest.approx(want)


def test_meta_analysis_of_sets_deals_entries_once(spark, monkeypatch):
    """By order and by set; weights and sums of a set are found where its entries are."""
    from locusflow.plans import catalog

    monkeypatch.setattr(J, "LEAST_ROWS", 500)
    monkeypatch.setattr(S, "SAMPLED", 1)
    plan = plans_of(catalog.QUERIES["q_sparse_meta"](spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"Exchange hashpartitioning\(annot", plan)) == 1
    assert re.findall(r"Exchange hashpartitioning\((trait|group)", plan) == ["group"]  # of the groups' numbers of blocks


def test_tasks_of_gene_set_annotations_grow_with_the_variants(spark, monkeypatch):
    from locusflow.plans import catalog

    monkeypatch.setattr(J, "TASK_ROWS", 500)
    d = "/root/testdata/sf0.001"
    tasks = str(-(-7 * spark.read.parquet(f"{d}/orders.parquet").count() // 500))
    plan = plans_of(catalog.QUERIES["q_gene_set_annot"](spark, d))
    assert re.findall(r"hashpartitioning\((variant_id)#\d+L, (\d+)\), REPARTITION", plan) == [("variant_id", tasks)]
    assert set(re.findall(r"hashpartitioning\(gene_idx#\d+L, _part#\d+, (\d+)\)", plan)) == {tasks}
