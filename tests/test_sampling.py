import pytest
from pyspark.sql import functions as F

from locusflow.operators import sampling
from locusflow.plans.convert import convert_store
from locusflow.sources.store import ScoreStore


def test_random_annotations(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("RSID"), (F.col("id") % 4 == 0).cast("double").alias("a"), F.rand(1).alias("c"))
    got = sampling.random_variants(rows, {"x": 0.25}, seed=3)
    n = got.where("x").count()
    assert 400 < n < 600 and n == sampling.random_variants(rows.repartition(3), {"x": 0.25}, seed=3).where("x").count()
    out = sampling.perturb(rows, ["a", "c"], 0.5, seed=2)
    assert "c" not in out.columns and 350 < out.where("a = 1").count() < 650
    assert sampling.perturb(rows, ["a"], 0.0).select("RSID", "a").exceptAll(rows.select("RSID", "a")).isEmpty()
    with pytest.raises(ValueError):
        sampling.perturb(rows, ["a"], 1.5)


def test_random_gene_sets(spark):
    genes = spark.createDataFrame([(f"G{i}",) for i in range(40)], "gene_id string")
    got = sampling.random_gene_sets(genes, {"s": 0.25, "t": 0.5})
    assert {r.set_name: r["count"] for r in got.groupBy("set_name").count().collect()} == {"s": 10, "t": 20}


def test_convert(spark, tmp_path):
    genes = spark.createDataFrame([(i, f"G{i}", f"N{i}", 1, 10 * i) for i in range(4)], "gene_idx long, gene_id string, gene_name string, CHR long, POS long")
    s, t = ScoreStore(spark, str(tmp_path / "v")), ScoreStore(spark, str(tmp_path / "g"))
    rows = spark.createDataFrame([(i, f"r{i}", 1, p, b) for i, (p, b) in enumerate([(0, 0), (1, 0), (11, 1), (19, 1), (30, 2)])], "ordinal long, RSID string, CHR long, POS long, jackknife_blocks int")
    s.create(rows, "variant", ["RSID"])
    for name in ("a", "b"):
        s.write_trait(name, rows.select("ordinal", (F.col("ordinal") + 1.0).alias("gradient")))
    s.write_groups({"m": ["a", "b"]})
    convert_store(s, t, genes, (1.0,))
    got = {r.gene_id: (r.gradient, r.jackknife_blocks) for r in t.load_trait("a").collect()}
    assert got == {"G0": (3.0, 0), "G1": (3.0, 1), "G2": (4.0, 1), "G3": (5.0, 2)}
    assert t.groups() == {"m": ["a", "b"]} and t.meta() == ("gene", ["gene_id"])
