import math

import pytest
from pyspark.sql import functions as F

from locusflow.operators import joins as J
from locusflow.sources import annotations as N
from locusflow.sources import ldgm, store, sumstats
from locusflow.streaming.scores import stream_scores


def test_ldsc(spark, tmp_path):
    p = tmp_path / "x.sumstats"
    p.write_text("SNP\tA1\tA2\tBeta\tse\tN\na\tC\tA\t1\t0.5\t100\nb\tG\tT\t1\t0\t40\nc\tG\tT\tx\t1\t\n")
    rows = {r.SNP: r for r in sumstats.read_ldsc_sumstats(spark, str(p)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].Z == 2 and rows["a"].ALT == "C" and rows["a"].REF == "A" and rows["b"].Z == math.inf
    assert [r.SNP for r in sumstats.read_ldsc_sumstats(spark, str(p), maximum_missingness=0.5).collect()] == ["a"]
    (tmp_path / "y.sumstats").write_text("SNP\tA1\tA2\tN\na\tC\tA\t1\n")
    with pytest.raises(ValueError):
        sumstats.read_ldsc_sumstats(spark, str(tmp_path / "y.sumstats"))


VCF = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\nchr1\t10\ta\tA\tC\t.\tPASS\t.\tES:SE:LP\t2:1:0.5\n1\t20\tb\tA\tC\t.\tPASS\t.\tSE:LP:ES\t1:0.5:3\nX\t30\tc\tA\tC\t.\tPASS\t.\tES:SE:LP\t1:1:1\n1\t40\td\tA\tC\t.\tPASS\t.\tES:SE:LP\t0:0:1\n1\t50\te\tA\tC\t.\tPASS\t.\tES:SE:LP\t1\n"


def test_vcf(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    rows = {r.ID: r for r in sumstats.read_sumstats(spark, str(tmp_path / "x.vcf")).collect()}
    assert {k: r.Z for k, r in rows.items()} == {"a": 2.0, "b": 3.0} and rows["a"].CHR == 1
    (tmp_path / "y.vcf").write_text(VCF.replace("FORMAT\tS", "FORMAT\tS\tT"))
    with pytest.raises(ValueError, match="exactly one sample"):
        sumstats.read_gwas_vcf(spark, str(tmp_path / "y.vcf"))


def test_parquet_traits(spark, tmp_path):
    p = str(tmp_path / "x.parquet")
    spark.createDataFrame([("a", 1, 5, 1.0, 0.5, 2.0, 1.0), ("b", 1, 6, 1.0, 0.0, 3.0, 1.0)], "SNP string, CHR int, BP int, h_BETA double, h_SE double, b_BETA double, b_SE double").write.parquet(p)
    assert sumstats.parquet_traits(spark, p) == ["b", "h"]
    assert [(r.SNP, r.Z, r.N) for r in sumstats.read_parquet_sumstats(spark, p, "h").collect()] == [("a", 2.0, None)]
    assert sumstats.read_parquet_sumstats_multi(spark, p).count() == 3
    with pytest.raises(ValueError):
        sumstats.read_parquet_sumstats_multi(spark, p, ["no"])


def test_bed(spark, tmp_path):
    from locusflow.operators.joins import bed_membership

    p = tmp_path / "r.bed"
    p.write_text("track x\n# c\n\nchr1 99 100\nchr1\t101\t102\tn\n")
    v = spark.createDataFrame([(1, 100), (1, 101), (1, 102)], "CHR long, POS long")
    got = {r.POS: r.r for r in bed_membership(v, N.read_bed(spark, str(p)), "r").collect()}
    assert got == {100: True, 101: False, 102: True}
    p.write_text("chr1 1\n")
    with pytest.raises(Exception, match="wrong number"):
        N.read_bed(spark, str(p)).collect()


def test_annotations(spark, tmp_path):
    (tmp_path / "a.1.annot").write_text("CHR\tBP\tSNP\tCM\tbase\tx\n1\t10\ta\t0\t1\t0\n1\t20\tb\t0\t1\t1\n")
    (tmp_path / "b.1.annot").write_text("CHR\tBP\tSNP\tCM\ty\n1\t10\ta\t0\t0.5\n1\t20\tb\t0\t2\n")
    (tmp_path / "a.2.annot").write_text("CHR\tBP\tSNP\tCM\tbase\n2\t10\tc\t0\t1\n")
    (tmp_path / "z.bed").write_text("chr1\t9\t10\n")
    df = N.load_annotations(spark, str(tmp_path))
    kinds = dict(df.dtypes)
    assert kinds["x"] == "boolean" and kinds["base"] == "double" and kinds["y"] == "double"
    rows = {r.SNP: r for r in df.collect()}
    assert rows["b"].y == 2 and rows["c"].y is None and rows["a"].z and not rows["b"].z


def test_genes_and_sets(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("a\tb\tc\td\te\tf\nG2\tv\tN2\t30\t41\t1\nG1\tv\t\t10\t20\t1\nGX\tv\tn\t1\t2\tX\n")
    rows = N.load_gene_table(spark, str(tmp_path / "g.tsv")).orderBy("gene_idx").collect()
    assert [(r.gene_id, r.POS, r.gene_name) for r in rows] == [("G1", 15, "NA"), ("G2", 35, "N2")]
    (tmp_path / "s.gmt").write_text("s1\td\tG1\tG2\ns1\td\tG2\nbad\tx\n")
    assert [(r.set_name, r.gene) for r in N.load_gene_sets(spark, str(tmp_path)).collect()] == [("s1", "G2")]


def test_blocks(spark, tmp_path):
    (tmp_path / "1kg_chr1_1_100.EUR.edgelist").write_text("0,0,2\n0,2,-1\n2,2,2\n1,1,0\n")
    (tmp_path / "1kg_chr1_1_100.snplist").write_text("index,anc_alleles,deriv_alleles,EUR,site_ids,position,swap\n0,A,C,0.1,a,5,0\n1,A,G,0.2,b,6,0\n2,AT,G,0.3,c,7,0\n")
    meta = ldgm.create_metadata(spark, str(tmp_path))
    row = meta.first()
    assert (row.numVariants, row.numIndices, row.numEntries) == (3, 3, 4)
    store.write_tsv(meta, str(tmp_path / "m"), True)
    meta.coalesce(1).write.csv(str(tmp_path / "meta"), header=True)
    blocks = ldgm.read_metadata(spark, str(tmp_path / "meta"), ["EUR"])
    edges, variants = ldgm.compact(ldgm.read_edges(spark, str(tmp_path), blocks), ldgm.read_snplists(spark, str(tmp_path), blocks))
    assert sorted((r.i, r.j, r.value) for r in ldgm.symmetric(edges).collect()) == [(0, 0, 2.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 2.0)]
    assert sorted((r.site_ids, r["index"]) for r in variants.collect()) == [("a", 0), ("c", 1)]
    with pytest.raises(ValueError):
        ldgm.read_metadata(spark, str(tmp_path / "meta"), ["EAS"])


def test_score_store(spark, tmp_path):
    from locusflow.cli import main

    path = str(tmp_path / "store")
    s = store.ScoreStore(spark, path)
    rows = spark.createDataFrame([(i, f"r{i}", b) for i, b in enumerate([0, 0, 1, 1, 2])], "ordinal long, RSID string, jackknife_blocks int")
    s.create(rows, "variant", ["RSID"])
    s.validate_rows(rows)
    with pytest.raises(ValueError):
        s.validate_rows(rows.withColumn("RSID", F.lit("x")))
    for t in ("t1", "t2"):
        s.write_trait(t, rows.select("ordinal", (F.col("ordinal") + 1.0).alias("gradient")))
    with pytest.raises(FileExistsError):
        s.write_trait("t1", rows.select("ordinal"))
    assert main(["add-meta", path, "g", "t*"], spark) == ["t1", "t2"]
    (tmp_path / "a.tsv").write_text("RSID\ta\tb\n" + "".join(f"r{i}\t{a}\t{b}\n" for i, (a, b) in enumerate(zip([1, 0, 1, 0, 1], [0, 1, 1, 1, 0], strict=True))))
    main(["test", path, str(tmp_path / "out"), "--annotations", str(tmp_path / "a.tsv")], spark)
    got = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True)
    assert got.columns == ["annotation", "g_Z", "t1_Z", "t2_Z"] and got.count() == 2
    main(["mv", path, "t1", "t9"], spark)
    assert s.traits() == ["t2", "t9"] and s.groups() == {"g": ["t2", "t9"]}
    main(["rm", path, "t9"], spark)
    assert s.traits() == ["t2"] and s.groups() == {}
    assert main(["show", path], spark)["rows"] == 5


def test_score_golden(spark):
    from locusflow.operators.aggregates import score_statistics

    rows = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [0, 0, 1, 1, 2], [1.0, 0.0, 1.0, 0.0, 1.0], strict=True)), "grad double, jk int, a double").withColumn("annot", F.lit("a"))
    got = {r.jk: (r.u_total, r.u_loo) for r in score_statistics(rows).collect()}
    assert got == {0: (9.0, 8.0), 1: (9.0, 6.0), 2: (9.0, 4.0)}


def test_runs_golden(spark):
    from locusflow.operators.aggregates import with_runs

    rows = spark.createDataFrame(list(enumerate([7, 7, 9, 9, 9, 12])), "ordinal long, b int")
    assert [r.run for r in with_runs(rows, "b", chunks=2).orderBy("ordinal").collect()] == [0, 0, 1, 1, 1, 2]


def test_stream(spark, tmp_path):
    schema = "jk int, grad double, a double"
    spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 1.0), (1, 3.0, 0.0)], schema).write.parquet(str(tmp_path / "in"))
    q = stream_scores(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["a"]).writeStream.format("memory").queryName("scores").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.jk, r.u) for r in spark.table("scores").collect()} == {(0, 3.0), (1, 0.0)}


def test_nearest_genes_at_one_position_go_by_index(spark):
    genes = [(1, 100, i) for i in range(1, 11)] + [(1, 300, i) for i in range(21, 51)] + [(1, 9000, 60), (2, 5, 70)]
    places = [(1, 200), (2, 150), (3, 290), (4, 300), (5, 100), (6, 5000)]
    v = spark.createDataFrame([(i, 1, p) for i, p in places], "variant_id long, CHR long, POS long")
    got = {(r.variant_id, r.rank): r.gene_idx for r in J.nearest_genes(v, spark.createDataFrame(genes, "CHR long, POS long, gene_idx long")).collect()}
    want = {i: sorted((abs(q - p), g) for c, q, g in genes if c == 1)[:7] for i, p in places}
    assert got == {(i, k): g for i, w in want.items() for k, (_, g) in enumerate(w)}


def test_genes_are_numbered_once_each_when_a_sort_is_sampled(spark, tmp_path):
    """With more genes than the sample of a sort's ranges, two sorts need not have the same ranges."""
    n = 30_000
    spark.range(n).selectExpr("concat_ws('\t', concat('G', id), 'v', 'n', id * 7919 % 1000003, id * 7919 % 1000003 + 1, id % 22 + 1) AS value").repartition(3).write.text(str(tmp_path / "g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [(r.gene_idx, r.CHR, r.midpoint, r.gene_id) for r in N.load_gene_table(spark, str(tmp_path / "g")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = [r[1:] for r in sorted(found)]
    assert sorted(r[0] for r in found) == list(range(len(rows))) and rows == sorted(rows)


def test_ranges_of_any_length_stand_in_two_bins_and_find_their_points(spark, monkeypatch):
    from locusflow.operators import joins as J

    monkeypatch.setattr(J, "BROADCAST_ROWS", 10)
    regions = [(k, k % 2, k * 37 - 500, k * 37 - 500 + n) for k, n in enumerate([0, 1, 2, 3, 64, 700, 5000, 1_000_000, 3_000_000_000] * 4)]
    b = spark.createDataFrame(regions, "block_id long, chrom long, chromStart long, chromEnd long")
    bins = b.where("chromStart < chromEnd").select(F.size(J.ranges(F.col("chromStart"), F.col("chromEnd"))).alias("n"))
    assert bins.agg(F.max("n")).first()[0] == 2
    v = [(i, i % 2, p) for i, p in enumerate([*range(-520, 1500, 7), 10**6, 10**9, 5 * 10**9])]
    found = J.partition_variants(spark.createDataFrame(v, "id long, CHR long, POS long"), b)
    assert found.columns == ["id", "CHR", "POS", "block_id"]
    assert sorted((r.id, r.block_id) for r in found.collect()) == sorted((i, k) for i, c, p in v for k, d, lo, hi in regions if c == d and lo <= p < hi)


def test_written_lines_are_spread_and_each_file_has_the_header(spark):
    from locusflow.plans.files import written_lines
    from locusflow.sources.sumstats import read_ldsc_snplist

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = written_lines(spark.range(5000).selectExpr("id", "concat('r', id) AS s"), ["SNP\tA1\tA2"], ["s", "id", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    assert len(files) > 1 and all(spark.read.text(f).first().value == "SNP\tA1\tA2" for f in files)
    assert sorted(r.SNP for r in read_ldsc_snplist(spark, path).collect()) == sorted(f"r{i}" for i in range(5000))
    assert read_ldsc_snplist(spark, written_lines(spark.range(0), ["SNP\tA1\tA2"], ["id", "id", "id"])).count() == 0
