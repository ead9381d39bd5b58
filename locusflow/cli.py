"""Command line: per-block models over files, and the score store."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.links import LINKS
from .functions.ordinal import with_ordinal
from .operators import aggregates as A
from .operators import joins as J
from .operators import sparse as S
from .operators.joins import partition_variants
from .operators.sampling import random_gene_sets
from .plans import models as M
from .plans.convert import convert_store
from .sources import annotations, ldgm, store, sumstats


def _fraction(text: str) -> float:
    x = float(text)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("must be in [0, 1]")
    return x


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="locusflow")
    sub = out.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--metadata", required=True)
    shared.add_argument("--blocks", required=True, help="folder of edge and variant lists")
    shared.add_argument("--population", default="EUR")
    shared.add_argument("--chromosome", type=int, action="append")
    for name in ("blup", "clump", "surrogates", "reml"):
        p = sub.add_parser(name, parents=[shared])
        p.add_argument("sumstats")
        p.add_argument("out")
        p.add_argument("--maximum-missingness", type=_fraction)
        if name == "blup":
            p.add_argument("--heritability", type=_fraction, required=True)
            p.add_argument("--sample-size", type=float)
        if name == "clump":
            p.add_argument("--min-chisq", type=float, default=30.0)
            p.add_argument("--max-rsq", type=_fraction, default=0.1)
        if name == "reml":
            p.add_argument("--annot-dir")
            p.add_argument("--gene-annot-dir", help="folder of GMT files")
            p.add_argument("--genes", help="gene table, for gene sets")
            p.add_argument("--annot-names", nargs="+")
            p.add_argument("--binary-annotations-only", action="store_true")
            p.add_argument("--trait", action="append", help="trait of a Parquet file; all of them without")
            p.add_argument("--iterations", type=int, default=50)
            p.add_argument("--denominator", type=float)
            p.add_argument("--intercept", type=float, default=1.0)
            p.add_argument("--max-chisq", type=float, help="leave out blocks with a larger squared Z")
            p.add_argument("--surrogates", help="surrogate map")
            p.add_argument("--scores", help="score store to write to")
            p.add_argument("--hessian", action="store_true")
            p.add_argument("--link", default="softplus", choices=sorted(LINKS))
            p.add_argument("--trace", default="exact", choices=("exact", "hutchinson", "xdiag"), help="how the inverse's diagonal is found")
            p.add_argument("--samples", type=int, default=100, help="probes of a trace estimate")
            p.add_argument("--seed", type=int, default=0)
            p.add_argument("--trust-steps", type=int, default=20, help="most trust values of an iteration")
            p.add_argument("--reset-trust", action="store_true", help="begin each iteration at the first trust value")
            p.add_argument("--convergence", help="where to write the likelihoods of the iterations")
    for name, more in {"test": ["out"], "show": [], "add-meta": ["group", "patterns"], "rm": ["pattern"], "mv": ["old", "new"], "convert": ["genes", "target"]}.items():
        p = sub.add_parser(name)
        p.add_argument("store")
        for a in more:
            p.add_argument(a, nargs="+" if a == "patterns" else None)
        if name == "test":
            p.add_argument("--annotations", help="one table with the store's keys")
            p.add_argument("--annot-dir", help="folder of annotation and BED files")
            p.add_argument("--gene-annot-dir", help="folder of GMT files")
            p.add_argument("--genes", help="gene table, for gene sets")
            p.add_argument("--annot-names", nargs="+")
            p.add_argument("--trait", help="trait or group; all of them without")
            p.add_argument("--random-genes", type=float, nargs="+", default=[], help="shares of genes in random sets")
            p.add_argument("--random-variants", type=float, nargs="+", default=[], help="probabilities of random annotations")
            p.add_argument("--perturb", type=_fraction, help="share of rows to redraw in binary annotations")
            p.add_argument("--seed", type=int, default=0)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("locusflow").getOrCreate()
    if hasattr(args, "store"):
        return _store(spark, args)
    blocks = ldgm.read_metadata(spark, args.metadata, [args.population], args.chromosome)
    edges, variants = ldgm.compact(ldgm.read_edges(spark, args.blocks, blocks), ldgm.read_snplists(spark, args.blocks, blocks, args.population))
    if args.command == "reml":
        return _reml(spark, args, blocks, edges, variants)
    options = {} if args.maximum_missingness is None else {"maximum_missingness": args.maximum_missingness}
    rows = with_ordinal(sumstats.read_sumstats(spark, args.sumstats, **options))
    vcf = ".vcf" in args.sumstats.lower()
    how = {"by_position": vcf or args.command == "clump", "ref": "REF", "alt": "ALT"}
    inside = partition_variants(rows, blocks)
    if args.command == "blup":
        size = args.sample_size or A.sample_size(rows, "NS" if "NS" in rows.columns else "N", "median")
        return store.write_tsv(M.blup(variants, inside, edges, args.heritability, size, **how).drop("ordinal", "block_id"), args.out)
    if args.command == "clump":
        found = M.clump(variants, inside, edges, rows, args.max_rsq, args.min_chisq, **how)
        return store.write_tsv(found.where("is_index").drop("ordinal", "is_index"), args.out)
    if args.command == "surrogates":
        found = M.surrogates(variants, inside, edges, **how).join(J.small(blocks.select("block_id", F.col("name").alias("block_name"))), "block_id").drop("block_id")
        return store.write_surrogates(found, args.out, store.block_fingerprints(variants, blocks))
    raise ValueError(args.command)


def reml_annotations(spark: SparkSession, args: argparse.Namespace, variants) -> tuple:
    """(annotations by SNP, their names): files or gene sets, over the blocks' variants; without
    either the one annotation that all have."""
    if args.annot_dir and args.gene_annot_dir:
        raise ValueError("a folder of annotations or of gene sets, not both")
    if args.annot_dir:
        annots = annotations.load_annotations(spark, args.annot_dir, args.chromosome)
        names = [c for c in annots.columns if c not in annotations.COORDINATES]
        if args.binary_annotations_only:
            names, _ = annotations.binary_subset(annots, names)
    else:
        annots, names = ldgm.block_annotations(variants), ["base"]
    if args.gene_annot_dir:
        if not args.genes:
            raise ValueError("gene sets need a gene table")
        places = annots.select(F.col("SNP").alias("variant_id"), "CHR", "POS").dropDuplicates(["variant_id"])
        sets, more = annotations.gene_set_columns(spark, args.gene_annot_dir, places, annotations.load_gene_table(spark, args.genes, args.chromosome))
        annots, names = annots.join(sets.withColumnRenamed("variant_id", "SNP"), "SNP"), more
    names = [c for c in names if not args.annot_names or c in args.annot_names]
    return annots.select("SNP", "CHR", "POS", *[F.col(c).cast("double").alias(c) for c in names]), names


def _reml(spark: SparkSession, args: argparse.Namespace, blocks, edges, variants) -> object:
    """All traits in one fit, over annotations that are read once.  A single trait's results are
    a table of annotations; of several, each adds a row to tables of estimates, errors and p."""
    options = {} if args.maximum_missingness is None else {"maximum_missingness": args.maximum_missingness}
    parquet = args.sumstats.lower().endswith(".parquet")
    traits = (args.trait or sumstats.parquet_traits(spark, args.sumstats)) if parquet else [args.trait[0] if args.trait else "trait"]
    annots, names = reml_annotations(spark, args, variants)
    annots = annots.persist()
    surrogate_map = None
    if args.surrogates:
        found = store.read_surrogate_map(spark, args.surrogates, store.block_fingerprints(variants, blocks))
        surrogate_map = found.join(J.small(blocks.select("block_id", F.col("name").alias("block_name"))), "block_name").select("block_id", F.col("index").cast("int"), F.col("surrogate_index").cast("int"))
    how = {"by_position": ".vcf" in args.sumstats.lower(), "ref": "REF", "alt": "ALT"}
    rows, settings, packed = {}, {}, None
    for trait in traits:
        one = sumstats.read_parquet_sumstats(spark, args.sumstats, trait, **options) if parquet else sumstats.read_sumstats(spark, args.sumstats, **options)
        rows[trait] = one = with_ordinal(one).drop("CHR", "POS").join(annots, "SNP")
        inside = partition_variants(one, blocks)
        if args.max_chisq is not None:
            inside = A.drop_extreme_blocks(inside, args.max_chisq)
        settings[trait] = M.RemlOptions(A.sample_size(one), args.intercept, args.denominator or float(one.count()), args.iterations, trust_steps=args.trust_steps, reset_trust=args.reset_trust, link=args.link, trace=args.trace, samples=args.samples, seed=args.seed)
        mine = M.reml_blocks(variants, inside, edges, names, settings[trait], surrogate_map, **how).withColumn("trait", F.lit(trait))
        packed = mine if packed is None else packed.unionByName(mine)
    packed = M.with_groups(packed.persist(), next(iter(settings.values())).groups).persist()
    fits = M.fit_traits(packed, {t: [0.0] * len(names) for t in traits}, settings)
    for trait in traits:
        fit, report = fits[trait], M.reml_report(rows[trait], names, fits[trait], settings[trait])
        if args.scores:
            M.write_scores(store.ScoreStore(spark, args.scores), trait, packed.where(F.col("trait") == trait), variants, fit, names, settings[trait], args.hessian)
        if args.convergence:
            store.write_convergence(fit, f"{args.convergence}/{trait}" if len(traits) > 1 else args.convergence, spark)
        if len(traits) == 1:
            store.write_tall_results(spark.createDataFrame(report), args.out)
            continue
        for kind in [c for c in report.columns if c != "annotation"]:
            values = [trait, *[float(x) for x in report[kind]]]
            store.append_results(spark.createDataFrame([values], ", ".join(["trait string", *[f"`{n}` double" for n in names]])), f"{args.out}/{kind}")
    packed.unpersist()
    annots.unpersist()
    return traits


def _store(spark: SparkSession, args: argparse.Namespace) -> object:
    s = store.ScoreStore(spark, args.store)
    if args.command == "show":
        rows, traits = s.rows(), s.traits()
        out = {"traits": traits, "groups": s.groups(), "rows": rows.count(), "columns": rows.columns, "datasets": {"rows": dict(rows.dtypes)}}
        if traits:
            counts = {r.trait: r.n for r in s.load_traits(traits).groupBy("trait").agg(F.count("*").alias("n")).collect()}  # a row per trait
            own = {t: {c: k for c, k in s.load_trait(t).dtypes if c not in rows.columns} for t in traits}
            out["datasets"] |= {t: {"rows": counts.get(t, 0), **own[t]} for t in traits}
        print(out)
        return out
    if args.command == "add-meta":
        return s.add_group(args.group, args.patterns)
    if args.command == "rm":
        return s.remove(args.pattern)
    if args.command == "mv":
        return s.rename(args.old, args.new)
    if args.command == "convert":
        return convert_store(s, store.ScoreStore(spark, args.target), annotations.load_gene_table(spark, args.genes))
    return _test(spark, args, s)


def _random_name(share: float) -> str:
    return f"random_{share:g}".replace(".", "_")


def test_annotations(spark: SparkSession, args: argparse.Namespace, s: store.ScoreStore) -> tuple:
    """(rows, entries, names, keys) of a score test: the store's rows that are tested, with
    their keys, and the annotations of a table, files, gene sets and chance as sparse entries."""
    rows, (kind, keys) = s.rows(), s.meta()
    tested, names, parts = rows.select("ordinal", *keys, *[c for c in ("CHR", "POS") if c in rows.columns and c not in keys]), [], []
    if sum(map(bool, (args.annotations, args.annot_dir, args.gene_annot_dir, args.random_genes, args.random_variants))) != 1:
        raise ValueError("exactly one source of annotations is needed")
    if args.random_variants and kind == "gene":
        raise ValueError("random variants need a store at variant level")
    if args.annotations:
        table = spark.read.csv(args.annotations, sep="\t", header=True, inferSchema=True)
        names += [c for c in table.columns if c not in keys]
        tested = tested.join(table.select(*keys).distinct(), keys, "left_semi")
        parts.append((keys, S.entries(table, keys, names)))
    if args.annot_dir:
        more, own, on = annotations.load_variant_annotations(spark, args.annot_dir, rows, args.annot_names)
        tested = tested.join(more.select(*on).distinct(), on, "left_semi")
        parts.append((on, S.entries(more, on, own)))
        names += own
    sets = None
    if args.gene_annot_dir:
        sets = annotations.load_gene_sets(spark, args.gene_annot_dir, args.annot_names)
    if args.random_genes:
        genes = rows if kind == "gene" else annotations.load_gene_table(spark, args.genes)
        drawn = random_gene_sets(genes, {_random_name(x): x for x in args.random_genes}, args.seed)
        sets = drawn if sets is None else sets.unionByName(drawn)
    if sets is not None:
        if kind == "gene":
            members = rows.select("ordinal", F.explode(F.array_distinct(F.array("gene_id", "gene_name"))).alias("gene")).join(sets, "gene").select("ordinal", F.col("set_name").alias("annot")).distinct()
            parts.append((["ordinal"], members.withColumn("value", F.lit(1.0))))
        else:
            places = rows.select(F.col("ordinal").alias("variant_id"), "CHR", "POS")
            long = J.gene_set_annotations(J.nearest_genes(places, genes := annotations.load_gene_table(spark, args.genes)), genes, sets, len(J.NEAREST_WEIGHTS) * places.count())
            parts.append((["ordinal"], long.select(F.col("variant_id").alias("ordinal"), F.col("set_name").alias("annot"), "value")))
        names += sorted(r.set_name for r in sets.select("set_name").distinct().collect())  # a row per set
    if args.random_variants:
        drawn = {_random_name(x): x for x in args.random_variants}
        parts.append((["ordinal"], S.random_entries(rows, ["ordinal"], drawn, keys[0], args.seed)))
        names += list(drawn)
    if not names:
        raise ValueError("no annotations to test")
    found = sumstats.union_all([tested.select("ordinal", *on).join(part, on).select("ordinal", "annot", "value") if on != ["ordinal"] else part.join(tested.select("ordinal"), "ordinal") for on, part in parts])
    if args.perturb is not None:
        keyed = tested.select("ordinal", keys[0])
        found = S.perturbed(keyed, found.join(keyed, "ordinal"), ["ordinal"], args.perturb, keys[0], args.seed)
        left = {r.annot for r in found.select("annot").distinct().collect()}  # a row per annotation
        names = [n for n in names if n in left]
    return tested, found, names, keys


def _test(spark: SparkSession, args: argparse.Namespace, s: store.ScoreStore) -> object:
    tested, found, names, _ = test_annotations(spark, args, s)
    traits = s.names(args.trait)
    if not traits:
        raise KeyError(args.trait)
    scores = s.load_traits(traits).join(tested.select("ordinal"), "ordinal", "left_semi").select("ordinal", "trait", F.col("jackknife_blocks").alias("jk"), F.col("gradient").alias("grad"))
    sums, blocks = S.block_sums(scores, found, ["ordinal"], ("trait",)), S.n_blocks(scores, ("trait",))
    every = spark.createDataFrame([(n,) for n in names], "annot string")
    z = S.with_all(S.score_z(sums, blocks, ("trait",)), every, ("trait",)).select(F.concat("trait", F.lit("_Z")).alias("name"), "annot", "z")
    groups = {g: ts for g, ts in s.groups().items() if set(ts) <= set(traits)}
    if groups:
        meta = S.with_all(S.meta_z(sums, blocks, spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "group string, trait string")), every, ("group",))
        z = z.unionByName(meta.select(F.concat("group", F.lit("_Z")).alias("name"), "annot", "z"))
    columns = sorted({f"{x}_Z" for x in [*traits, *groups]})
    wide = z.groupBy(F.col("annot").alias("annotation")).agg(*[F.max(F.when(F.col("name") == c, F.col("z"))).alias(c) for c in columns])  # a column per trait
    store.write_tsv(wide, args.out, one_file=True)
    rms = {r["name"]: r.rms for r in A.rms_z(wide, columns).collect()}
    print("root mean square of Z:", rms)
    return rms


if __name__ == "__main__":
    main()
