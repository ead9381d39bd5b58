"""The commands end to end, over files as a user has them."""

import numpy as np
import pytest

from locusflow import cli
from locusflow.sources.store import ScoreStore


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Three blocks of eight variants, statistics of two traits, annotations, genes and sets."""
    root = tmp_path_factory.mktemp("files")
    rng = np.random.default_rng(1)
    blocks, annots, genes = root / "blocks", root / "annot", root / "sets"
    for folder in (blocks, annots, genes, root / "beds"):
        folder.mkdir()
    meta = ["chrom,chromStart,chromEnd,name,snplistName,population,numVariants,numIndices,numEntries,info"]
    stats = ["SNP\tCHR\tPOS\tA1\tA2\tBeta\tse\tN"]
    lines = ["CHR\tBP\tSNP\tCM\tbase\tcoding\tscore"]
    wide = []
    for b in range(3):
        name = f"1kg_chr1_{b * 100}_{b * 100 + 100}"
        (blocks / f"{name}.EUR.edgelist").write_text("\n".join([f"{i},{i},2.0" for i in range(8)] + [f"{i},{i + 1},-0.4" for i in range(7)]) + "\n")
        snps = ["index,anc_alleles,deriv_alleles,EUR,site_ids,position,swap"]
        for i in range(8):
            rsid, pos = f"rs{b}_{i}", b * 100 + 10 * i + 5
            snps.append(f"{i},A,C,0.{i + 1},{rsid},{pos},0")
            beta, more = rng.normal(size=2)
            stats.append(f"{rsid}\t1\t{pos}\tC\tA\t{beta}\t0.5\t1000")
            wide.append((rsid, 1, pos, "A", "C", 1000.0, float(beta), 0.5, float(more), 0.5))
            lines.append(f"1\t{pos}\t{rsid}\t0\t1\t{i % 2}\t{0.25 * i}")
        (blocks / f"{name}.snplist").write_text("\n".join(snps) + "\n")
        meta.append(f"1,{b * 100},{b * 100 + 100},{name}.EUR.edgelist,{name}.snplist,EUR,8,8,15,")
    (root / "metadata.csv").write_text("\n".join(meta) + "\n")
    (root / "one.sumstats").write_text("\n".join(stats) + "\n")
    (annots / "a.1.annot").write_text("\n".join(lines) + "\n")
    (root / "beds" / "half.bed").write_text("chr1 0 150\n")
    (root / "genes.tsv").write_text("a\tb\tc\td\te\tf\n" + "".join(f"ENSG{k}\tENSG{k}.1\tG{k}\t{20 * k}\t{20 * k + 4}\t1\n" for k in range(12)))
    (genes / "s.gmt").write_text("low\tx\tENSG0\tG1\tG2\nhigh\tx\tENSG10\tENSG11\n")
    return root, wide


def run(spark, *args):
    return cli.main([str(a) for a in args], spark)


def table(spark, path, sep="\t"):
    return {r[0]: r.asDict() for r in spark.read.csv(str(path), sep=sep, header=True, inferSchema=True).collect()}


def test_blup_clump_and_surrogates(spark, files, tmp_path):
    root, _ = files
    where = ["--metadata", root / "metadata.csv", "--blocks", root / "blocks"]
    run(spark, "blup", root / "one.sumstats", tmp_path / "blup", "--heritability", "0.3", *where)
    assert len(table(spark, tmp_path / "blup")) == 24
    run(spark, "clump", root / "one.sumstats", tmp_path / "clump", "--min-chisq", "1", *where)
    assert 0 < len(table(spark, tmp_path / "clump")) < 24
    run(spark, "surrogates", root / "one.sumstats", tmp_path / "map", *where)
    assert spark.read.parquet(str(tmp_path / "map" / "map")).where("index = surrogate_index").count() == 24


def test_reml_writes_a_store_that_test_and_convert_read(spark, files, tmp_path):
    root, _ = files
    where = ["--metadata", root / "metadata.csv", "--blocks", root / "blocks", "--iterations", "3"]
    scores = tmp_path / "scores"
    with pytest.raises(ValueError, match="not both"):
        run(spark, "reml", root / "one.sumstats", tmp_path / "no", "--annot-dir", root / "annot", "--gene-annot-dir", root / "sets", "--genes", root / "genes.tsv", *where)
    run(spark, "reml", root / "one.sumstats", tmp_path / "sets", "--gene-annot-dir", root / "sets", "--genes", root / "genes.tsv", *where[:-2], "--iterations", "1", "--link", "exponential", "--trace", "hutchinson")
    assert set(table(spark, tmp_path / "sets", ",")) == {"low", "high"}
    run(spark, "reml", root / "one.sumstats", tmp_path / "out", "--annot-dir", root / "annot",
        "--scores", scores, "--hessian", "--convergence", tmp_path / "steps", "--max-chisq", "1000", "--trait", "t", *where)
    assert set(table(spark, tmp_path / "out", ",")) == {"base", "coding", "score"}
    steps = table(spark, tmp_path / "steps")
    assert [steps[k]["log_likelihood"] for k in sorted(steps)] == sorted(s["log_likelihood"] for s in steps.values())
    store = ScoreStore(spark, str(scores))
    found = store.load_trait("t")
    assert found.count() == 24 and {"gradient", "hessian", "RSID", "CHR", "POS", "jackknife_blocks"} <= set(found.columns)
    assert [r.name for r in store.parameters("t").collect()] == ["base", "coding", "score"]
    run(spark, "test", scores, tmp_path / "z", "--annot-dir", root / "annot", "--annot-names", "coding", "score")
    assert set(table(spark, tmp_path / "z")) == {"coding", "score"}
    scored = found.select("gradient", "RSID").toPandas()
    values = {x.split("\t")[2]: [float(v) for v in x.split("\t")[4:]] for x in (root / "annot" / "a.1.annot").read_text().splitlines()[1:]}
    assert np.allclose(np.array([values[r] for r in scored.RSID]).T @ scored.gradient, 0, atol=1e-8)  # annotations are projected out
    run(spark, "test", scores, tmp_path / "bed", "--annot-dir", root / "beds", "--perturb", "0.1")
    run(spark, "test", scores, tmp_path / "random", "--random-variants", "0.5")
    run(spark, "test", scores, tmp_path / "sets_z", "--gene-annot-dir", root / "sets", "--genes", root / "genes.tsv")
    assert set(table(spark, tmp_path / "bed")) == {"half"} and set(table(spark, tmp_path / "random")) == {"random_0_5"} and set(table(spark, tmp_path / "sets_z")) == {"low", "high"}
    with pytest.raises(ValueError, match="exactly one"):
        run(spark, "test", scores, tmp_path / "two", "--random-variants", "0.5", "--annot-dir", root / "beds")
    shown = run(spark, "show", scores)
    assert shown["datasets"]["t"]["rows"] == 24 and shown["datasets"]["t"]["gradient"] == "double"
    run(spark, "convert", scores, root / "genes.tsv", tmp_path / "genes")
    run(spark, "test", tmp_path / "genes", tmp_path / "gz", "--gene-annot-dir", root / "sets", "--genes", root / "genes.tsv")
    run(spark, "test", tmp_path / "genes", tmp_path / "gr", "--random-genes", "0.5", "--genes", root / "genes.tsv")
    assert set(table(spark, tmp_path / "gz")) == {"low", "high"} and set(table(spark, tmp_path / "gr")) == {"random_0_5"}


def test_reml_of_several_traits(spark, files, tmp_path):
    root, wide = files
    spark.createDataFrame(wide, "SNP string, CHR long, POS long, REF string, ALT string, N double, x_BETA double, x_SE double, y_BETA double, y_SE double").write.parquet(str(tmp_path / "two.parquet"))
    run(spark, "reml", tmp_path / "two.parquet", tmp_path / "out", "--annot-dir", root / "annot", "--binary-annotations-only", "--scores", tmp_path / "scores",
        "--metadata", root / "metadata.csv", "--blocks", root / "blocks", "--iterations", "2", "--annot-names", "coding")
    assert set(table(spark, tmp_path / "out" / "enrichment")) == {"x", "y"}
    store = ScoreStore(spark, str(tmp_path / "scores"))
    assert store.traits() == ["x", "y"]
    run(spark, "add-meta", tmp_path / "scores", "both", "x", "y")
    run(spark, "test", tmp_path / "scores", tmp_path / "z", "--annot-dir", root / "annot")
    assert "both_Z" in table(spark, tmp_path / "z")["coding"]
    store.write_trait("a/b", store.load_trait("x").select("ordinal", "gradient"))
    assert store.traits() == ["a_b", "x", "y"]
    with pytest.raises(ValueError):
        store.write_trait("a=b", store.load_trait("x").select("ordinal", "gradient"))
