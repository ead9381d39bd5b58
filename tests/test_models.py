"""Block algebra and models against dense NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.plans import models as M
from locusflow.plans.precision import Block, likelihood_gradient, likelihood_hessian, log_likelihood


@pytest.fixture
def matrix():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(6, 6))
    return a @ a.T + 6 * np.eye(6)


def test_selection_is_a_schur_complement(matrix):
    b, keep = Block(matrix), np.array([0, 2, 5])
    part, inverse = b[keep], np.linalg.inv(matrix)
    x = np.arange(3.0)
    assert np.allclose(part.solve(x), inverse[np.ix_(keep, keep)] @ x)
    assert np.allclose(part.multiply(part.solve(x)), x)
    assert np.isclose(part.logdet(), -np.linalg.slogdet(inverse[np.ix_(keep, keep)])[1])
    assert np.allclose(part.inverse_diagonal(), np.diag(inverse)[keep])
    assert np.allclose(part.solve_iteratively(x)[0], part.solve(x), atol=1e-6)


def test_diagonal_estimators(matrix):
    b, exact = Block(matrix), np.diag(np.linalg.inv(matrix))
    assert np.allclose(b.inverse_diagonal("hutchinson", 4000, 1), exact, atol=0.05)
    assert np.allclose(b.inverse_diagonal("xdiag", 6, 1), exact, atol=0.05)


def test_diagonal_update_refuses_non_positive(matrix):
    with pytest.raises(ValueError):
        Block(matrix).plus_diagonal(-100.0)


def test_likelihood_and_hessian_golden():
    m = Block(np.array([[2.0, -1.0], [-1.0, 2.0]]) / 10).plus_diagonal(1.0)
    h = likelihood_hessian(np.array([0.1, 0.1]), m, np.eye(2))
    assert h[0, 0] == pytest.approx(-0.00347, rel=0.2) and h[0, 1] == pytest.approx(h[1, 0])
    assert np.isfinite(log_likelihood(np.array([0.1, 0.1]), m))


def test_trust_region_golden():
    step, predicted = M.trust_region_step(np.array([1.0]), np.array([[-1.0]]), 5.0)
    assert step[0] == pytest.approx(1 / 6, abs=1e-6) and predicted > 0


def test_greedy_clump():
    r = np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1.0]])
    assert M.greedy_clump(np.array([6.0, 7.0, 5.6]), r, 30, 0.1).tolist() == [False, True, True]


def _tables(spark):
    v = spark.createDataFrame([(0, 0, 0, "a", 10, "A", "C", 0.2), (0, 1, 1, "b", 20, "A", "G", 0.3), (0, 2, 2, "c", 30, "T", "C", 0.4)], "block_id long, ordinal long, index int, site_ids string, position long, anc_alleles string, deriv_alleles string, af double")
    s = spark.createDataFrame([(0, 0, "a", "C", "A", 2.0), (0, 1, "b", "A", "G", 1.0), (0, 2, "x", "A", "C", 5.0)], "block_id long, ordinal long, SNP string, A1 string, A2 string, Z double")
    e = spark.createDataFrame([(0, i, i, 1.0) for i in range(3)], "block_id long, i int, j int, value double")
    return v, s, e


def test_blup_with_identity_precision(spark):
    v, s, e = _tables(spark)
    got = {r.ordinal: r.weight for r in M.blup(v, s, e, 0.2, 100.0).collect()}
    scale = 10 * 0.1 / (1 + 100 * 0.1)
    assert got[0] == pytest.approx(2 * scale) and got[1] == pytest.approx(-1 * scale) and got[2] == 0


def test_clump_keeps_rows(spark):
    v, s, e = _tables(spark)
    got = M.clump(v, s, e, s.drop("block_id"), 0.1, 3.0).orderBy("ordinal").collect()
    assert [(r.ordinal, r.is_index) for r in got] == [(0, True), (1, False), (2, False)]


def test_surrogates_map_missing_to_matched(spark):
    v, s, e = _tables(spark)
    got = {r["index"]: r.surrogate_index for r in M.surrogates(v, s, e).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_stochastic_traces_agree_with_exact_ones(matrix):
    m, pz = Block(matrix), np.arange(6.0)
    exact_g, exact_h = likelihood_gradient(pz, m), likelihood_hessian(pz, m)
    assert np.allclose(likelihood_gradient(pz, m, method="xdiag", samples=6, seed=1), exact_g, atol=0.05)
    assert np.allclose(likelihood_hessian(pz, m, method="hutchinson", samples=4000, seed=1), exact_h, rtol=0.3, atol=0.05)
    assert np.allclose(exact_h, np.diag(likelihood_hessian(pz, m, np.eye(6))))
    assert np.allclose(m.plus_element(2, 1.5).diagonal() - m.diagonal(), [0, 0, 1.5, 0, 0, 0]) and np.allclose(m.inv()(pz), m.solve(pz))


def test_variant_scores_are_derivatives(spark):
    """Gradient and Hessian by a variant's argument of the link, against differences."""
    v, s, e = _tables(spark)
    e = e.union(spark.createDataFrame([(0, 0, 1, 0.3), (0, 1, 2, -0.2)], "block_id long, i int, j int, value double"))
    s = s.withColumn("SNP", F.when(F.col("SNP") == "x", "c").otherwise(F.col("SNP"))).withColumn("A1", F.when(F.col("SNP") == "c", "C").otherwise(F.col("A1"))).withColumn("A2", F.when(F.col("SNP") == "c", "T").otherwise(F.col("A2")))
    s = s.withColumns({f"v{k}": F.when(F.col("ordinal") == k, 1.0).otherwise(0.0) for k in range(3)})  # a parameter for each variant
    names, options = ["v0", "v1", "v2"], M.RemlOptions(sample_size=50.0, denominator=20.0)
    packed = M.reml_blocks(v, s, e, names, options).persist()
    theta, h = np.array([0.3, -0.4, 0.1]), 1e-4
    ll = lambda t: sum(r.ll for r in M.evaluate(packed, t, options, False).collect())
    scores = {r.ordinal: r for r in M.variant_scores(packed, theta, options, hessian=True).collect()}
    for k in range(3):
        step = h * np.eye(3)[k]
        assert scores[k].gradient == pytest.approx((ll(theta + step) - ll(theta - step)) / (2 * h), rel=1e-3, abs=1e-7)
    total = M.evaluate(packed, theta, options).collect()
    assert np.allclose([scores[k].gradient for k in range(3)], total[0].g)
    p = 1 / (1 + np.exp(-theta))
    slope, curve = p / 20, p * (1 - p) / 20
    hessian = np.diag(np.array(total[0].h).reshape(3, 3)) + [scores[k].gradient / slope[k] * curve[k] for k in range(3)]
    assert np.allclose([scores[k].hessian for k in range(3)], hessian)


def test_reml_increases_the_likelihood(spark):
    from locusflow.plans.catalog import block_tables

    v, s, e = block_tables(spark, "/root/testdata/sf0.001")
    options = M.RemlOptions(sample_size=1000.0, denominator=1000.0, iterations=4)
    packed = M.reml_blocks(v, s, e, ["base", "odd"], options)
    fit = M.fit_reml(packed, ["base", "odd"], options)
    assert fit["likelihood"][-1] >= fit["likelihood"][0]
    thetas = M.jackknife_thetas(fit["theta"], fit["blocks"], 4)
    assert thetas.shape[1] == 2 and M.wald_log10_p(thetas[:, 0]) <= 0
    report = M.reml_report(s, ["base", "odd"], fit, options)
    rows = s.select("base", "odd").toPandas().to_numpy(float)
    h2 = np.log1p(np.exp(rows @ fit["theta"])) / options.denominator
    assert np.allclose(report.heritability, h2 @ rows) and report.enrichment[0] == 1 and report.enrichment_log10p[0] == 0


def test_jackknife_steps_go_uphill():
    """For a quadratic likelihood the step from anywhere ends at the maximum without the group."""
    from types import SimpleNamespace

    rng = np.random.default_rng(2)
    h = [-np.eye(2) * x for x in rng.uniform(1, 3, 6)]
    top = rng.normal(size=(6, 2))
    theta = np.zeros(2)
    blocks = [SimpleNamespace(g=(-a @ (m - theta)).tolist(), h=a.ravel().tolist()) for a, m in zip(h, top, strict=True)]
    got = M.jackknife_thetas(theta, blocks, 6)
    for k in range(6):
        rest = [i for i in range(6) if i != k]
        best = np.linalg.solve(sum(h[i] for i in rest), sum(h[i] @ top[i] for i in rest))
        assert np.allclose(got[k], best, atol=1e-6)


def test_small_blocks_are_dense_and_large_ones_keep_their_entries(spark):
    from pyspark.sql import functions as F

    from locusflow.plans.models import SMALL, per_block

    sizes = spark.createDataFrame([(1, 40), (2, SMALL + 1)], "block_id long, n int")
    rows = sizes.select("block_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("index"), "n").withColumn("ordinal", F.col("index").cast("long"))
    edges = rows.select("block_id", F.col("index").alias("i"), F.col("index").alias("j"), F.lit(2.0).alias("value")).unionByName(rows.where("index < n - 1").select("block_id", F.col("index").alias("i"), (F.col("index") + 1).alias("j"), F.lit(-0.5).alias("value")))
    found = per_block(rows, edges, "block_id long, kind string, rows int", lambda r, b: __import__("pandas").DataFrame({"block_id": [r["block_id"].iloc[0]], "kind": [type(b).__name__], "rows": [len(r)]})).collect()
    assert sorted((r.block_id, r.kind, r.rows) for r in found) == [(1, "Block", 40), (2, "SparseBlock", SMALL + 1)]
