"""The library's operators as queries over the standard tables, each with its DuckDB SQL.

Stand-ins: ``orders`` are variants with statistics (rid, chr, pos, z, jk, a1, a2), ``part``
blocks, regions and genes, ``lineitem`` a wide table of traits, ``events`` a table with
missing values, ``embeddings`` the correlation structure of blocks (one per label).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import frequency_term, ieee_div, is_finite, jackknife_group, link
from ..functions.ordinal import keep_first
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sparse as S
from ..sources.annotations import detect_binary
from ..sources.sumstats import keep_complete, read_parquet_sumstats_multi
from . import models as M
from .files import written

QUERIES: dict = {}
ORACLES: dict = {}

_V = """v AS (SELECT o_orderkey AS rid, o_custkey % 22 + 1 AS chr, o_orderkey AS pos, (o_totalprice - 250000) / 100000 AS z, o_orderkey // 150 AS jk,
  (o_orderpriority = '1-URGENT')::INT::DOUBLE AS a1, (o_orderstatus = 'F')::INT::DOUBLE AS a2, o_orderstatus AS st FROM orders)"""
_G = "g AS (SELECT p_partkey AS gene_idx, p_partkey::VARCHAR AS gene_id, p_name AS gene_name, (p_size % 22 + 1)::BIGINT AS chr, p_partkey * 7 AS pos, p_brand FROM part)"
_B = "b AS (SELECT p_partkey AS block_id, p_partkey % 22 + 1 AS chrom, p_partkey * 9 AS lo, p_partkey * 9 + 700 AS hi FROM part)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def variants(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("rid"), (F.col("o_custkey") % 22 + 1).alias("CHR"), F.col("o_orderkey").alias("POS"), ((F.col("o_totalprice") - 250000) / 100000).alias("z"),
        F.floor(F.col("o_orderkey") / 150).alias("jk"), (F.col("o_orderpriority") == "1-URGENT").cast("int").cast("double").alias("a1"), (F.col("o_orderstatus") == "F").cast("int").cast("double").alias("a2"), F.col("o_orderstatus").alias("st"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("gene_idx"), F.col("p_partkey").cast("string").alias("gene_id"), F.col("p_name").alias("gene_name"), (F.col("p_size") % 22 + 1).cast("long").alias("CHR"), (F.col("p_partkey") * 7).alias("POS"), "p_brand")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("block_id"), (F.col("p_partkey") % 22 + 1).alias("chrom"), (F.col("p_partkey") * 9).alias("chromStart"), (F.col("p_partkey") * 9 + 700).alias("chromEnd"))


_LOO = """per AS (SELECT annot, jk, sum(g * a) AS u FROM long GROUP BY annot, jk), tot AS (SELECT annot, sum(u) AS ut FROM per GROUP BY annot),
loo AS (SELECT annot, jk, u, ut, ut - u AS ul FROM per JOIN tot USING (annot))"""


@query(f"""WITH {_V}, long AS (SELECT jk, z AS g, 'a1' AS annot, a1 AS a FROM v UNION ALL SELECT jk, z, 'a2', a2 FROM v), {_LOO}
SELECT annot, round(max(ut), 6) AS u, round(max(ut) / (stddev_pop(ul) * sqrt(count(*) - 1)), 6) AS z FROM loo GROUP BY annot""")
def q_score_test(spark, d):
    out = A.score_test(variants(spark, d), ["a1", "a2"], gradient="z")
    return out.select("annot", F.round("u", 6).alias("u"), F.round("z", 6).alias("z"))


@query(f"""WITH {_V}, long AS (SELECT jk, z AS g, 'a1' AS annot, a1 AS a FROM v), {_LOO} SELECT jk, round(u, 6) AS u, round(ul, 6) AS u_loo FROM loo""")
def q_leave_one_out(spark, d):
    v = variants(spark, d).select("jk", F.col("z").alias("grad"), F.lit("a1").alias("annot"), F.col("a1").alias("a"))
    return A.score_statistics(v).select("jk", F.round("u", 6).alias("u"), F.round("u_loo", 6).alias("u_loo"))


@query(f"""WITH {_V}, long AS (SELECT t || '|' || an AS annot, jk, g, a FROM (
  SELECT 't1' AS t, 'a1' AS an, jk, z AS g, a1 AS a FROM v UNION ALL SELECT 't1', 'a2', jk, z, a2 FROM v UNION ALL
  SELECT 't2', 'a1', jk, z * z, a1 FROM v UNION ALL SELECT 't2', 'a2', jk, z * z, a2 FROM v)), {_LOO},
w AS (SELECT annot, 1 / var_pop(ul) AS w FROM loo GROUP BY annot),
c AS (SELECT split_part(annot, '|', 2) AS annot, jk, sum(w * ul) AS ul, sum(w * ut) AS ut FROM loo JOIN w USING (annot) GROUP BY 1, 2)
SELECT 'm' AS "group", annot, round(max(ut) / (stddev_pop(ul) * sqrt(count(*) - 1)), 6) AS z FROM c GROUP BY annot""")
def q_meta(spark, d):
    v = variants(spark, d)
    traits = F.array(F.struct(F.lit("t1").alias("trait"), F.col("z").alias("grad")), F.struct(F.lit("t2").alias("trait"), (F.col("z") * F.col("z")).alias("grad")))
    annots = F.array(F.struct(F.lit("a1").alias("annot"), F.col("a1").alias("a")), F.struct(F.lit("a2").alias("annot"), F.col("a2").alias("a")))
    long = v.select("jk", F.explode(traits).alias("t"), "a1", "a2").select("jk", "t", F.explode(annots).alias("n")).select("jk", "t.trait", "t.grad", "n.annot", "n.a")
    stats = A.score_statistics(long, ("trait", "annot"))
    groups = spark.createDataFrame([("m", "t1"), ("m", "t2")], "group string, trait string")
    return A.meta_analysis(stats, groups).select("group", "annot", F.round("z", 6).alias("z"))


_SETS = f"""{_V}, e AS (SELECT l_orderkey AS rid, l_partkey AS annot, sum(l_quantity) AS a FROM lineitem GROUP BY 1, 2),
t AS (SELECT 't1' AS trait, rid, jk, z AS g FROM v UNION ALL SELECT 't2', rid, jk, z * z FROM v),
u AS (SELECT trait, annot, jk, sum(g * a) AS u FROM t JOIN e USING (rid) GROUP BY ALL), nb AS (SELECT count(DISTINCT jk) AS b FROM v),
f AS (SELECT trait, annot, n.jk, coalesce(u.u, 0) AS u FROM (SELECT DISTINCT trait, annot FROM u) CROSS JOIN (SELECT DISTINCT jk FROM v) n LEFT JOIN u USING (trait, annot, jk))"""


def part_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(scores of two traits, entries): a set per part, holding the orders with that part, so
    there are thousands of sets of some thirty members each.  Lines are dealt by order, once
    for the sums of an order's parts and for the join with its scores."""
    scores = variants(spark, d).select("rid", "jk", F.col("z").alias("t1"), (F.col("z") * F.col("z")).alias("t2"))
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("rid"), F.col("l_partkey").alias("annot"), "l_quantity")
    found = lines.repartition(J.n_tasks(spark, lines.count()), "rid").groupBy("rid", "annot").agg(F.sum("l_quantity").alias("value"))
    return scores, found


def part_sums(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(sums by trait, set and block, number of blocks by trait)."""
    scores, found = part_sets(spark, d)
    traits = F.explode(F.array(F.lit("t1"), F.lit("t2"))).alias("trait")
    return S.trait_sums(scores, found, ["rid"], ["t1", "t2"]), S.n_blocks(scores).select(traits, "blocks")


@query(f"""WITH {_SETS} SELECT trait, annot, round(sum(u), 8) AS u, round(sum(u) / (stddev_pop(u) * sqrt(count(*) - 1)), 6) AS z FROM f GROUP BY trait, annot""")
def q_sparse_sets(spark, d):
    """Score tests of thousands of sets and two traits at once; the SQL spells out every block."""
    z = S.score_z(*part_sums(spark, d), ("trait",))
    return z.select("trait", "annot", F.round("u", 8).alias("u"), F.round("z", 6).alias("z"))


@query(f"""WITH {_SETS}, w AS (SELECT trait, annot, 1 / var_pop(u) AS w FROM f GROUP BY trait, annot), c AS (SELECT annot, jk, sum(w * u) AS u FROM f JOIN w USING (trait, annot) GROUP BY annot, jk)
SELECT 'm' AS "group", annot, round(sum(u) / (stddev_pop(u) * sqrt(count(*) - 1)), 6) AS z FROM c GROUP BY annot""")
def q_sparse_meta(spark, d):
    groups = spark.createDataFrame([("m", "t1"), ("m", "t2")], "group string, trait string")
    z = S.meta_z(*part_sums(spark, d), groups)
    return z.select("group", "annot", F.round("z", 6).alias("z"))


@query(f"WITH {_V}, {_B} SELECT block_id, count(*) AS n, sum(pos)::BIGINT AS total FROM v JOIN b ON v.chr = b.chrom AND pos >= lo AND pos < hi GROUP BY block_id")
def q_partition(spark, d):
    return J.partition_variants(variants(spark, d), blocks(spark, d)).groupBy("block_id").agg(F.count("*").alias("n"), F.sum("POS").alias("total"))


@query(f"WITH {_V}, {_B} SELECT rid, EXISTS (SELECT 1 FROM b WHERE v.chr = b.chrom AND pos - 1 >= lo AND pos - 1 < hi) AS in_region FROM v")
def q_interval(spark, d):
    return J.bed_membership(variants(spark, d), blocks(spark, d), "in_region").select("rid", "in_region")


@query(f"""WITH {_B}, o AS (SELECT *, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b),
i AS (SELECT *, sum(CASE WHEN p >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY lo, hi) AS k FROM o)
SELECT chrom, min(lo) AS "chromStart", max(hi) AS "chromEnd" FROM i GROUP BY chrom, k""")
def q_merge_intervals(spark, d):
    return J.merge_intervals(blocks(spark, d))


_KNN = f"""{_V}, {_G}, few AS (SELECT v.rid FROM v LEFT JOIN (SELECT chr, count(*) AS n FROM g GROUP BY chr) c USING (chr) WHERE coalesce(n, 0) < 7),
c AS (SELECT rid, gene_idx, 0 AS far, abs(v.pos - g.pos) AS d FROM v JOIN g USING (chr) UNION ALL
  SELECT rid, gene_idx, 1, abs(v.chr * 1000000000 + v.pos - g.chr * 1000000000 - g.pos) FROM v JOIN few USING (rid) JOIN g ON v.chr <> g.chr),
k AS (SELECT rid, gene_idx, row_number() OVER (PARTITION BY rid ORDER BY far, d, gene_idx) - 1 AS rank FROM c),
n AS (SELECT rid, rank::INT AS rank, gene_idx, [0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05][rank + 1]::DOUBLE AS weight FROM k WHERE rank < 7)"""


def _nearest(spark, d):
    return J.nearest_genes(variants(spark, d), genes(spark, d), variant_id="rid")


@query(f"WITH {_KNN} SELECT rid AS variant_id, rank, gene_idx, weight FROM n")
def q_knn_genes(spark, d):
    return _nearest(spark, d).withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {_KNN} SELECT rid AS variant_id, p_brand AS set_name, round(sum(weight), 9) AS value FROM n JOIN g USING (gene_idx) GROUP BY 1, 2")
def q_gene_set_annot(spark, d):
    g, rows = genes(spark, d), len(J.NEAREST_WEIGHTS) * variants(spark, d).count()
    out = J.gene_set_annotations(_nearest(spark, d), g, g.select(F.col("p_brand").alias("set_name"), F.col("gene_id").alias("gene")), rows)
    return out.withColumn("value", F.round("value", 9))


@query(f"""WITH {_KNN}, s AS (SELECT gene_idx, sum(weight * z) AS g FROM n JOIN v USING (rid) GROUP BY gene_idx),
f AS (SELECT jk, min(rid) AS rid FROM v GROUP BY jk), st AS (SELECT f.jk, n.gene_idx AS a FROM f JOIN n USING (rid) WHERE rank = 0),
sp AS (SELECT jk, a, coalesce(lead(a) OVER (ORDER BY a, jk), 1::BIGINT << 62) AS b FROM st)
SELECT g.gene_idx, round(coalesce(s.g, 0), 6) AS gradient, coalesce(jk, 0)::BIGINT AS jk FROM g LEFT JOIN s USING (gene_idx) LEFT JOIN sp ON g.gene_idx >= a AND g.gene_idx < b""")
def q_gene_scatter(spark, d):
    v = variants(spark, d).select(F.col("rid").alias("variant_id"), F.col("z").alias("grad"), "jk")
    return A.genes_from_variants(_nearest(spark, d), v, genes(spark, d)).withColumn("gradient", F.round("gradient", 6)).withColumn("jk", F.col("jk").cast("long"))


@query("""WITH b AS (SELECT p_partkey AS block_id, row_number() OVER (ORDER BY p_partkey) - 1 AS i, (SELECT count(*) FROM part) AS n FROM part), q AS (SELECT *, n // least(97, n) AS each, n % least(97, n) AS more FROM b)
SELECT block_id, (CASE WHEN i < more * (each + 1) THEN i // (each + 1) ELSE more + (i - more * (each + 1)) // each END)::BIGINT AS jk FROM q""")
def q_jackknife_groups(spark, d):
    """Blocks in order, in 97 runs of equal length, the first ones a block longer."""
    b = blocks(spark, d).select("block_id", F.lit(1).alias("one"))
    placed = A.offsets(b, "one", "block_id", "at")
    return placed.select("block_id", jackknife_group(F.col("at"), b.count(), 97).alias("jk"))


@query("""SELECT o_orderkey AS rid, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN 1.0 WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN -1.0
  WHEN o_custkey % 3 = 1 THEN 'NaN'::DOUBLE ELSE 0.0 END AS phase FROM orders""")
def q_allele_phase(spark, d):
    o = _t(spark, d, "orders").where("o_orderkey IS NOT NULL")
    third = F.col("o_custkey") % 3
    ref = F.when(third == 0, F.when(F.col("o_orderstatus") == "F", "a").when(F.col("o_orderstatus") == "O", "C").otherwise("g")).when(third == 2, "t")
    alt = F.when(third == 0, F.when(F.col("o_orderstatus") == "F", "C").when(F.col("o_orderstatus") == "O", "A").otherwise("c")).when(third == 2, "c")
    return o.select(F.col("o_orderkey").alias("rid"), J.allele_phase(F.lit("A"), F.lit("c"), ref, alt).alias("phase"))


@query("""WITH z AS (SELECT l_returnflag, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount WHEN l_quantity > 0 THEN 'inf'::DOUBLE WHEN l_quantity < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS z FROM lineitem)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE isfinite(z)) AS n_finite, round(sum(z) FILTER (WHERE isfinite(z)), 2) AS total FROM z GROUP BY 1""")
def q_zscore_ieee(spark, d):
    z = _t(spark, d, "lineitem").select("l_returnflag", ieee_div(F.col("l_quantity"), F.col("l_discount")).alias("z"))
    good = is_finite(F.col("z"))
    return z.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(good).alias("n_finite"), F.round(F.sum(F.when(good, F.col("z"))), 2).alias("total"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def q_dedupe_first(spark, d):
    return keep_first(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT event_type, count(*) AS n FROM events WHERE value >= 0.5 * (SELECT max(value) FROM events) GROUP BY event_type")
def q_missingness(spark, d):
    return keep_complete(_t(spark, d, "events"), "value", 0.5).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT 'discounted' AS name, bool_and(x IN (0, 1)) AND min(x) = 0 AND max(x) = 1 AS is_binary FROM (SELECT (l_discount > 0.05)::INT AS x FROM lineitem)
UNION ALL SELECT 'linenumber', bool_and(l_linenumber IN (0, 1)) AND min(l_linenumber) = 0 AND max(l_linenumber) = 1 FROM lineitem
UNION ALL SELECT 'ones', false FROM (SELECT 1)""")
def q_binary_detect(spark, d):
    x = _t(spark, d, "lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("discounted"), F.col("l_linenumber").alias("linenumber"), F.lit(1).alias("ones"))
    kinds = dict(detect_binary(x, x.columns).dtypes)
    return spark.createDataFrame([(c, kinds[c] == "boolean") for c in x.columns], "name string, is_binary boolean")


_TRAITS = "t AS (SELECT 'price' AS trait, l_extendedprice / l_quantity AS z, l_quantity AS n FROM lineitem UNION ALL SELECT 'tax', l_tax / l_quantity, l_quantity FROM lineitem)"


def _traits(spark, d):
    """A wide table of two traits, written and read by the reader of such files."""
    x = _t(spark, d, "lineitem").select(F.monotonically_increasing_id().cast("string").alias("site_ids"), F.col("l_quantity").alias("N"), F.col("l_extendedprice").alias("price_BETA"), F.col("l_quantity").alias("price_SE"), F.col("l_tax").alias("tax_BETA"), F.col("l_quantity").alias("tax_SE"))
    return read_parquet_sumstats_multi(spark, written(x, "parquet"))


@query(f"WITH {_TRAITS} SELECT trait, count(*) AS rows, round(sum(z), 3) AS total, round(sum(z * z), 2) AS chisq FROM t GROUP BY trait")
def q_traits_unpivot(spark, d):
    return _traits(spark, d).groupBy("trait").agg(F.count("*").alias("rows"), F.round(F.sum("Z"), 3).alias("total"), F.round(F.sum(F.col("Z") * F.col("Z")), 2).alias("chisq"))


@query(f"WITH {_TRAITS} SELECT trait, max(n) AS max_n, count(*) AS n_variants, round(avg(z * z), 4) AS mean_chisq, round(max(z * z), 4) AS max_chisq FROM t GROUP BY trait")
def q_chisq_summary(spark, d):
    out = A.chisq_summary(_traits(spark, d), ("trait",))
    return out.select("trait", "max_n", "n_variants", F.round("mean_chisq", 4).alias("mean_chisq"), F.round("max_chisq", 4).alias("max_chisq"))


@query("SELECT median(l_quantity) AS median_n, round(avg(l_quantity) FILTER (WHERE l_quantity > 0), 6) AS mean_n FROM lineitem")
def q_traits_sample_size(spark, d):
    n = _t(spark, d, "lineitem").select(F.col("l_quantity").alias("N"))
    return spark.createDataFrame([(A.sample_size(n, "N", "median"), round(A.sample_size(n), 6))], "median_n double, mean_n double")


@query(f"""WITH {_V}, m AS (SELECT sum(a1 * a1) AS aa, sum(a1 * a2) AS ab, sum(a2 * a2) AS bb, sum(a1 * z) AS ay, sum(a2 * z) AS bz FROM v)
SELECT rid, round(z - (a1 * (bb * ay - ab * bz) + a2 * (aa * bz - ab * ay)) / (aa * bb - ab * ab), 8) AS z FROM v, m""")
def q_project_out(spark, d):
    return A.project_out(variants(spark, d), "z", ["a1", "a2"]).select("rid", F.round("z", 8).alias("z"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (ORDER BY o_orderkey) AS p FROM orders)
SELECT o_orderkey AS ordinal, sum(CASE WHEN p IS NULL OR p = o_orderstatus THEN 0 ELSE 1 END) OVER (ORDER BY o_orderkey)::BIGINT AS run FROM o""")
def q_runs(spark, d):
    first = _t(spark, d, "orders").agg(F.min("o_orderkey")).first()[0] or 0
    x = _t(spark, d, "orders").select((F.col("o_orderkey") - first).alias("ordinal"), F.col("o_orderstatus").alias("st"))
    return A.with_runs(x, "st", chunks=4096).select((F.col("ordinal") + first).alias("ordinal"), "run")


@query(f"""WITH {_V}, {_B}, j AS (SELECT block_id, v.* FROM v JOIN b ON v.chr = b.chrom AND pos >= lo AND pos < hi),
k AS (SELECT block_id FROM j GROUP BY block_id HAVING max(z * z) <= 4) SELECT block_id, count(*) AS n FROM j JOIN k USING (block_id) GROUP BY block_id""")
def q_extreme_blocks(spark, d):
    j = J.partition_variants(variants(spark, d), blocks(spark, d))
    return A.drop_extreme_blocks(j, 4.0, "z").groupBy("block_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_V}, s AS (SELECT 0 AS k, 'base' AS annot, sum(z * z) AS h2, sum(1.0)::DOUBLE AS size FROM v UNION ALL SELECT 1, 'a1', sum(a1 * z * z), sum(a1) FROM v UNION ALL SELECT 2, 'a2', sum(a2 * z * z), sum(a2) FROM v)
SELECT annot, round(h2, 5) AS h2, size, round((h2 / size) / (SELECT h2 / size FROM s WHERE k = 0), 8) AS enrichment FROM s""")
def q_annotation_heritability(spark, d):
    v = variants(spark, d).withColumn("h2", F.col("z") * F.col("z")).withColumn("base", F.lit(1.0))
    return A.annotation_heritability(v, ["base", "a1", "a2"]).select("annot", F.round("h2", 5).alias("h2"), "size", F.round("enrichment", 8).alias("enrichment"))


@query(f"WITH {_V}, j AS (SELECT st, jk, sum(z) AS value FROM v GROUP BY st, jk) SELECT st, round(sqrt((count(*) - 1) * var_samp(value)), 6) AS se FROM j GROUP BY st")
def q_jackknife_se(spark, d):
    j = variants(spark, d).groupBy("st", "jk").agg(F.sum("z").alias("value"))
    return A.jackknife_se(j, ("st",)).select("st", F.round("se", 6).alias("se"))


@query(f"""WITH {_V} SELECT rid, round((greatest(z, 0) + ln(1 + exp(-abs(z)))) / 10, 9) AS h2, round(1 / (1 + exp(-z)) / 10, 9) AS slope,
  round(exp(-abs(z)) / pow(1 + exp(-abs(z)), 2) / 10, 9) AS curve FROM v""")
def q_link(spark, d):
    h, s, c = link(F.col("z"), 10.0)
    return variants(spark, d).select("rid", F.round(h, 9).alias("h2"), F.round(s, 9).alias("slope"), F.round(c, 9).alias("curve"))


@query("SELECT l_linenumber, round(sum(2 * (l_quantity / 100) * pow(1 - l_quantity / 100, 0.5)), 5) AS total FROM lineitem GROUP BY 1")
def q_frequency_term(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.sum(frequency_term(F.col("l_quantity") / 100, -0.5)), 5).alias("total"))


@query("""WITH s AS (SELECT o_custkey AS k, arg_min(o_totalprice, o_orderkey) AS z FROM orders GROUP BY 1)
SELECT c_custkey AS snp, c_nationkey AS p, round(z, 2) AS z FROM customer LEFT JOIN s ON c_custkey = k""")
def q_merge_annotations(spark, d):
    stats = _t(spark, d, "orders").select(F.col("o_custkey").alias("SNP"), F.col("o_totalprice").alias("Z"), F.col("o_orderkey").alias("ordinal"))
    annots = _t(spark, d, "customer").select(F.col("c_custkey").alias("SNP"), F.col("c_nationkey").alias("p"), F.col("c_custkey").alias("annot_ordinal"))
    return J.merge_annotations(stats, annots, ("SNP",), keep_unmatched=True).select(F.col("SNP").alias("snp"), "p", F.round("Z", 2).alias("z"))


@query(f"WITH {_V}, {_B}, m AS (SELECT DISTINCT rid FROM v JOIN b ON v.chr = b.chrom AND pos >= lo AND pos < hi WHERE z > 1) SELECT rid, m.rid IS NOT NULL AS is_index FROM v LEFT JOIN m USING (rid)")
def q_restore_rows(spark, d):
    v = variants(spark, d).withColumn("ordinal", F.col("rid"))
    marks = J.partition_variants(v, blocks(spark, d)).select("ordinal", (F.col("z") > 1).alias("is_index"))
    return J.restore_rows(v, marks).select("rid", "is_index")


@query(f"WITH {_B}, n AS (SELECT block_id, hi - lo + block_id AS n FROM b) SELECT block_id, (sum(n) OVER (ORDER BY block_id) - n)::BIGINT AS \"offset\" FROM n")
def q_block_offsets(spark, d):
    b = blocks(spark, d).select("block_id", (F.col("chromEnd") - F.col("chromStart") + F.col("block_id")).alias("n"))
    return A.offsets(b, "n", "block_id").select("block_id", "offset")


#: Blocks of 150 variants from ``orders``; with x = place in the block, (x, y) are correlated by 0.8 ^ |x - y|.
_BLOCKS = f"""{_V}, w AS (SELECT *, (row_number() OVER (PARTITION BY jk ORDER BY rid) - 1)::INT AS x, count(*) OVER (PARTITION BY jk) AS n FROM v)"""
RHO = 0.8


def ordered_blocks(spark: SparkSession, d: str, rho: float = 0.0, keep=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants, statistics and precision entries of blocks of neighbours in ``orders``: the
    identity, or the tridiagonal inverse of correlations rho ^ distance.  ``keep`` is a
    condition on the statistics there are."""
    v = variants(spark, d).withColumn("index", (F.row_number().over(W.partitionBy("jk").orderBy("rid")) - 1).cast("int")).withColumn("n", F.count("*").over(W.partitionBy("jk")))
    v = v.withColumn("block_id", F.col("jk").cast("long"))
    one = 1 / (1 - rho * rho)
    middle = (F.col("index") > 0) & (F.col("index") < F.col("n") - 1)
    own = v.select("block_id", F.col("index").alias("i"), F.col("index").alias("j"), F.when(F.col("n") == 1, 1.0).otherwise(F.when(middle, one * (1 + rho * rho)).otherwise(one)).alias("value"))
    edges = own if rho == 0 else own.unionByName(v.where(F.col("index") < F.col("n") - 1).select("block_id", F.col("index").alias("i"), (F.col("index") + 1).alias("j"), F.lit(-one * rho).alias("value")))
    lists = v.select("block_id", F.col("rid").alias("ordinal"), "index", F.col("rid").cast("string").alias("site_ids"), F.col("POS").alias("position"), F.col("CHR").cast("long").alias("CHR"), F.lit("A").alias("anc_alleles"), F.lit("C").alias("deriv_alleles"))
    stats = (v if keep is None else v.where(keep)).select("block_id", F.col("rid").alias("ordinal"), F.col("rid").cast("string").alias("SNP"), "POS", F.lit("C").alias("A1"), F.lit("A").alias("A2"), F.col("z").alias("Z"), F.lit(1.0).alias("base"), F.col("a1").alias("urgent"), F.col("a2").alias("filled"))
    return lists, stats, edges


@query(f"WITH {_V}, m AS (SELECT 0.2 / count(*) AS s FROM v) SELECT rid, round(sqrt(1000) * s / (1 + 1000 * s) * z, 9) AS weight FROM v, m")
def q_blup_identity(spark, d):
    lists, stats, edges = ordered_blocks(spark, d)
    return M.blup(lists, stats, edges, 0.2, 1000.0).select(F.col("ordinal").alias("rid"), F.round("weight", 9).alias("weight"))


@query(f"WITH {_V} SELECT rid, z * z >= 2 AS is_index FROM v")
def q_clump_identity(spark, d):
    lists, stats, edges = ordered_blocks(spark, d)
    return M.clump(lists, stats, edges, stats.select("ordinal", "Z"), 0.1, 2.0).select(F.col("ordinal").alias("rid"), "is_index")


@query(f"""WITH {_BLOCKS} SELECT a.rid, c.twin, round(sum(1.5 * b.z * pow(0.8, abs(a.x - b.x))), 6) AS x FROM w a JOIN w b ON a.jk = b.jk CROSS JOIN (VALUES (0), (1)) c(twin) GROUP BY a.rid, c.twin""")
def q_variant_solve(spark, d):
    """Two variants at every index, of which the second has half the first one's value."""
    lists, stats, edges = ordered_blocks(spark, d, RHO)
    rows = lists.join(stats.select("ordinal", F.col("Z").alias("b")), "ordinal").select("block_id", "index", "ordinal", "b")
    out = M.variant_solve(rows.unionByName(rows.withColumns({"ordinal": F.col("ordinal") + 1_000_000_000, "b": F.col("b") / 2})), edges)
    twin = (F.col("ordinal") >= 1_000_000_000).cast("int")
    return out.select((F.col("ordinal") - twin * 1_000_000_000).alias("rid"), twin.alias("twin"), F.round("x", 6).alias("x"))


@query(f"""WITH RECURSIVE {_BLOCKS}, m AS (SELECT 0.2 / count(*) AS s FROM v), q AS (SELECT *, CASE WHEN n = 1 THEN 1.0 WHEN x > 0 AND x < n - 1 THEN 1.64 / 0.36 ELSE 1 / 0.36 END AS p FROM w),
u AS (SELECT jk, x, n, rid, p + 1000 * s AS a, p * z - 0.8 / 0.36 * (coalesce(lag(z) OVER y, 0) + coalesce(lead(z) OVER y, 0)) AS b, s FROM q, m WINDOW y AS (PARTITION BY jk ORDER BY x)),
f AS (SELECT jk, x, a::DOUBLE AS d, b::DOUBLE AS t FROM u WHERE x = 0 UNION ALL SELECT u.jk, u.x, u.a - (0.8 / 0.36) * (0.8 / 0.36) / f.d, u.b + (0.8 / 0.36) / f.d * f.t FROM f JOIN u ON u.jk = f.jk AND u.x = f.x + 1),
g AS (SELECT f.jk, f.x, f.t / f.d AS w FROM f JOIN u USING (jk, x) WHERE f.x = u.n - 1 UNION ALL SELECT f.jk, f.x, (f.t + 0.8 / 0.36 * g.w) / f.d FROM g JOIN f ON f.jk = g.jk AND f.x = g.x - 1)
SELECT rid, round(sqrt(1000) * s * w, 9) AS weight FROM g JOIN u USING (jk, x)""")
def q_blup_tridiagonal(spark, d):
    """Weights in blocks of neighbours; the SQL eliminates forth and back, index by index."""
    lists, stats, edges = ordered_blocks(spark, d, RHO)
    return M.blup(lists, stats, edges, 0.2, 1000.0).select(F.col("ordinal").alias("rid"), F.round("weight", 9).alias("weight"))


@query(f"""WITH RECURSIVE {_BLOCKS}, o AS (SELECT jk, x, row_number() OVER (PARTITION BY jk ORDER BY z * z DESC, x) AS k FROM w WHERE z * z >= 2),
r AS (SELECT jk, 0::BIGINT AS k, []::INT[] AS leads FROM (SELECT DISTINCT jk FROM o) UNION ALL
  SELECT r.jk, r.k + 1, CASE WHEN len(list_filter(r.leads, lambda l: abs(l - o.x) <= 5)) = 0 THEN list_append(r.leads, o.x) ELSE r.leads END FROM r JOIN o ON o.jk = r.jk AND o.k = r.k + 1),
f AS (SELECT jk, unnest(max_by(leads, k)) AS x FROM r GROUP BY jk) SELECT rid, f.x IS NOT NULL AS is_index FROM w LEFT JOIN f ON w.jk = f.jk AND w.x = f.x""")
def q_clump_neighbours(spark, d):
    """An index variant prunes what it correlates with by 0.1 or more, which here is up to five
    places away (0.64 ^ 5 = 0.107)."""
    lists, stats, edges = ordered_blocks(spark, d, RHO)
    return M.clump(lists, stats, edges, stats.select("ordinal", "Z"), 0.1, 2.0).select(F.col("ordinal").alias("rid"), "is_index")


@query(f"""WITH {_BLOCKS}, s AS (SELECT jk, pos, rid AS stats_ordinal, z, rid % 3 AS k FROM w UNION ALL SELECT jk, pos, rid + 1000000000, z + 1, 1 FROM w WHERE rid % 7 = 0),
m AS (SELECT w.jk, w.x, w.rid, stats_ordinal, CASE WHEN k = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS phase, s.z * CASE WHEN k = 0 THEN 1 ELSE -1 END AS z FROM w JOIN s ON w.jk = s.jk AND w.pos = s.pos WHERE k < 2)
SELECT rid, stats_ordinal, phase, round(z, 9) AS z, (row_number() OVER (PARTITION BY jk, x ORDER BY rid, stats_ordinal) = 1)::INT AS is_representative FROM m""")
def q_merge_by_position(spark, d):
    """Statistics matched by position: alleles as in the list, swapped, or others, which go; a
    seventh of them twice, so that one of two represents its index."""
    lists, stats, _ = ordered_blocks(spark, d)
    k = F.col("ordinal") % 3
    turned = stats.withColumns({"A1": F.when(k == 0, "c").when(k == 1, "A").otherwise("G"), "A2": F.when(k == 0, "a").when(k == 1, "C").otherwise("T")})
    again = stats.where("ordinal % 7 = 0").withColumns({"ordinal": F.col("ordinal") + 1_000_000_000, "Z": F.col("Z") + 1, "A1": F.lit("A"), "A2": F.lit("C")})
    out = J.merge_snplists(lists, turned.unionByName(again), by_position=True, add_allelic=("Z",))
    return out.select(F.col("ordinal").alias("rid"), "stats_ordinal", "phase", F.round("Z", 9).alias("z"), F.col("is_representative").cast("int").alias("is_representative"))


@query(f"""WITH {_V}, x AS (SELECT jk, z, 0.5 + a1 AS m FROM v) SELECT jk, round(-0.5 * sum(ln(2 * pi()) + ln(m) + z * z / m), 5) AS ll FROM x GROUP BY jk""")
def q_loglik_diagonal(spark, d):
    lists, stats, edges = ordered_blocks(spark, d)
    own = stats.select(F.col("ordinal"), (0.5 + F.col("urgent")).alias("m"), F.col("Z").alias("pz"))
    rows = lists.join(own, "ordinal")
    diagonal = rows.select("block_id", F.col("index").alias("i"), F.col("index").alias("j"), F.col("m").alias("value"))
    return M.block_likelihoods(rows, diagonal).select(F.col("block_id").alias("jk"), F.round("ll", 5).alias("ll"))


@query(f"""WITH RECURSIVE {_BLOCKS}, c AS (SELECT jk, x, a1 = 0 AS s, CASE WHEN a1 = 0 THEN z ELSE 0 END AS y, CASE WHEN n = 1 THEN 1.0 WHEN x > 0 AND x < n - 1 THEN (1 + 0.64) / 0.36 ELSE 1 / 0.36 END AS a FROM w),
r AS (SELECT jk, x, s, a::DOUBLE AS d, y AS t, CASE WHEN s THEN NULL ELSE a END::DOUBLE AS u FROM c WHERE x = 0 UNION ALL
  SELECT c.jk, c.x, c.s, c.a - (0.8 / 0.36) * (0.8 / 0.36) / r.d, c.y + (0.8 / 0.36) / r.d * r.t, CASE WHEN NOT c.s THEN c.a - coalesce((0.8 / 0.36) * (0.8 / 0.36) / r.u, 0) END FROM r JOIN c ON c.jk = r.jk AND c.x = r.x + 1)
SELECT jk, round(-0.5 * (count(*) FILTER (WHERE s) * ln(2 * pi()) + sum(ln(d)) - coalesce(sum(ln(u)), 0) + sum(t * t / d)), 5) AS ll FROM r GROUP BY jk HAVING bool_or(s)""")
def q_loglik_tridiagonal(spark, d):
    """Likelihoods of a selection in blocks of neighbours, on sparse factors; the SQL eliminates
    index by index, for the whole block and for what isn't selected."""
    lists, stats, edges = ordered_blocks(spark, d, RHO)
    rows = lists.join(stats.where("urgent = 0").select("ordinal", F.col("Z").alias("pz")), "ordinal")
    return M.block_likelihoods(rows, edges).select(F.col("block_id").alias("jk"), F.round("ll", 5).alias("ll"))


@query(f"""WITH {_BLOCKS}, o AS (SELECT * FROM w WHERE a1 = 0), c AS (SELECT w.jk, w.x, o.x AS y, row_number() OVER (PARTITION BY w.jk, w.x ORDER BY abs(w.x - o.x), o.x) AS k FROM w JOIN o ON w.jk = o.jk)
SELECT w.jk AS block_id, w.x AS "index", abs(coalesce(c.y, w.x) - w.x) AS distance FROM w LEFT JOIN c ON w.jk = c.jk AND w.x = c.x AND k = 1""")
def q_surrogate_neighbours(spark, d):
    """With correlations that fall with distance, a missing index stands at one of its nearest
    (which of two, the last digits of an inverse decide)."""
    out = M.surrogates(*ordered_blocks(spark, d, RHO, F.col("a1") == 0))
    return out.select("block_id", "index", F.abs(F.col("surrogate_index") - F.col("index")).alias("distance"))


_REML = f"""{_V}, m AS (SELECT (SELECT count(*) FROM v)::DOUBLE AS den), t AS (SELECT *, 0.4 - 0.3 * a1 + 0.2 * a2 AS x FROM v),
l AS (SELECT t.*, (greatest(x, 0) + ln(1 + exp(-abs(x)))) / den AS h, 1 / (1 + exp(-x)) AS p, den FROM t, m),
e AS (SELECT *, 1 / 1000.0 + h AS c, z / sqrt(1000.0) AS y, p / den AS slope, p * (1 - p) / den AS curve FROM l),
g AS (SELECT *, -0.5 * (1 / c - y * y / (c * c)) AS node, -0.5 * y * y / (c * c) / c AS node2 FROM e)"""
THETA = (0.4, -0.3, 0.2)


def _reml_blocks(spark, d):
    lists, stats, edges = ordered_blocks(spark, d)
    options = M.RemlOptions(sample_size=1000.0, denominator=float(stats.count()))
    return lists, M.reml_blocks(lists, stats, edges, ["base", "urgent", "filled"], options), options


@query(f"""WITH {_REML} SELECT jk AS block_id, round(-0.5 * sum(ln(2 * pi()) + ln(c) + y * y / c), 4) AS ll, round(sum(node * slope), 7) AS g0, round(sum(node * slope * a1), 7) AS g1, round(sum(node * slope * a2), 7) AS g2 FROM g GROUP BY jk""")
def q_reml_likelihood(spark, d):
    """Likelihood and gradient of the blocks at fixed parameters."""
    _, packed, options = _reml_blocks(spark, d)
    out = M.evaluate(packed, np.array(THETA), options)
    return out.select("block_id", F.round("ll", 4).alias("ll"), *[F.round(F.get("g", F.lit(k)), 7).alias(f"g{k}") for k in range(3)])


@query(f"WITH {_REML} SELECT rid, round(node * slope, 8) AS gradient, round(node2 * slope * slope + node * curve, 8) AS hessian FROM g")
def q_variant_scores(spark, d):
    _, packed, options = _reml_blocks(spark, d)
    out = M.variant_scores(packed, np.array(THETA), options, hessian=True)
    return out.select(F.col("ordinal").alias("rid"), F.round("gradient", 8).alias("gradient"), F.round("hessian", 8).alias("hessian"))


def block_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants, statistics and precision entries of blocks made from embeddings: the vectors
    of a label and a range of 500 ids, so a block is bounded however many rows a label has."""
    block = F.col("label").cast("long") + 1000 * F.floor(F.col("vec_id") / 500)
    e = _t(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", block.alias("block_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    at = (F.row_number().over(W.partitionBy("block_id").orderBy("vec_id")) - 1).cast("int")
    e = e.withColumn("index", at)
    v = e.select("block_id", F.col("vec_id").alias("ordinal"), "index", F.col("vec_id").cast("string").alias("site_ids"), F.col("vec_id").alias("position"), F.lit("A").alias("anc_alleles"), F.lit("C").alias("deriv_alleles"), (F.lit(0.05) + F.pmod("vec_id", F.lit(9)) / 20).alias("af"))
    s = e.select("block_id", F.col("vec_id").alias("ordinal"), F.col("vec_id").cast("string").alias("SNP"), F.col("vec_id").alias("POS"), F.when(F.col("vec_id") % 7 == 0, "A").otherwise("C").alias("A1"), F.when(F.col("vec_id") % 7 == 0, "C").otherwise("A").alias("A2"), (F.col("e")[0] * 20).alias("Z"), F.lit(1.0).alias("base"), (F.col("vec_id") % 2).cast("double").alias("odd"))
    x, y = e.select("block_id", F.col("index").alias("i"), F.col("e").alias("x")), e.select("block_id", F.col("index").alias("j"), F.col("e").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda t, w: t + w)
    edges = x.join(y, "block_id").where("i <= j").select("block_id", "i", "j", (dot + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("value"))
    return v, s, edges


@query()
def q_blup(spark, d):
    v, s, e = block_tables(spark, d)
    return M.blup(v, s, e, 0.2, 1000.0).select(F.col("ordinal").alias("vec_id"), F.round("weight", 6).alias("weight"))


@query()
def q_clump(spark, d):
    v, s, e = block_tables(spark, d)
    return M.clump(v, s, e, s.select("ordinal", "Z"), max_rsq=0.01, min_chisq=4.0).select(F.col("ordinal").alias("vec_id"), "is_index")


@query()
def q_surrogate_map(spark, d):
    v, s, e = block_tables(spark, d)
    return M.surrogates(v, s.where("ordinal % 5 <> 0"), e)


@query()
def q_reml(spark, d):
    v, s, e = block_tables(spark, d)
    options = M.RemlOptions(sample_size=1000.0, denominator=1000.0, iterations=5)
    packed = M.reml_blocks(v, s, e, ["base", "odd"], options).persist()
    fit = M.fit_reml(packed, ["base", "odd"], options)
    packed.unpersist()
    rows = [(a, float(t), i) for i, (a, t) in enumerate(zip(["base", "odd"], fit["theta"], strict=True))]
    return spark.createDataFrame(rows, "annot string, theta double, place int")


@query("SELECT l_linenumber AS name, round(sqrt(avg(l_discount * l_discount)), 9) AS rms FROM lineitem GROUP BY 1")
def q_rms_z(spark, d):
    wide = _t(spark, d, "lineitem").select(*[F.when(F.col("l_linenumber") == k, F.col("l_discount")).alias(str(k)) for k in range(1, 8)])
    out = A.rms_z(wide, wide.columns).where("rms IS NOT NULL")
    return out.select(F.col("name").cast("int").alias("name"), F.round("rms", 9).alias("rms"))


@query("SELECT 'l_tax' AS name, count(*) FILTER (WHERE l_tax <> 0) AS n FROM lineitem UNION ALL SELECT 'l_discount', count(*) FILTER (WHERE l_discount <> 0) FROM lineitem")
def q_nonzero_counts(spark, d):
    return A.nonzero_counts(_t(spark, d, "lineitem"), ["l_tax", "l_discount"])


@query(f"""WITH {_V}, {_G}, c AS (SELECT rid, gene_idx, row_number() OVER (PARTITION BY rid ORDER BY abs(v.pos - g.pos), gene_idx) - 1 AS rank FROM v JOIN g ON g.pos BETWEEN v.pos - 14 AND v.pos + 14 OR g.gene_idx >= (SELECT max(gene_idx) FROM g) - 3 OR g.gene_idx <= 3)
SELECT rid AS variant_id, rank::INT AS rank, gene_idx FROM c WHERE rank < 2""")
def q_nearest_on_line(spark, d):
    out = J.nearest_on_line(variants(spark, d), genes(spark, d), (0.6, 0.4), "rid")
    return out.select("variant_id", F.col("rank").cast("int").alias("rank"), "gene_idx")


@query("""SELECT o_custkey % 22 + 1 AS chr, count(*) AS n, sum(n)::BIGINT AS first FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey % 22 ORDER BY o_orderkey) AS n, o_orderkey FROM orders) GROUP BY 1""")
def q_active_indices(spark, d):
    """Indices of a block renumbered in order."""
    v = variants(spark, d).select(F.col("CHR").alias("block_id"), (F.col("rid") * 3).alias("index"))
    out = J.active_indices(v).withColumn("active", F.col("active").cast("long") + 1)
    return out.groupBy(F.col("block_id").alias("chr")).agg(F.count("*").alias("n"), F.sum("active").alias("first"))
