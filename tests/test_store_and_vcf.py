"""Commits of the score store, and VCF files compressed in blocks."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from locusflow.sources import bgzf, sumstats
from locusflow.sources.store import ConcurrentCommit, ScoreStore


@pytest.fixture
def store(spark, tmp_path):
    s = ScoreStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(i, f"r{i}", i // 2) for i in range(6)], "ordinal long, RSID string, jackknife_blocks int")
    s.create(rows, "variant", ["RSID"])
    for t in ("t1", "t2"):
        s.write_trait(t, rows.select("ordinal", (F.col("ordinal") * (1.0 if t == "t1" else -1.0)).alias("gradient")), parameters=(["base"], [0.5]))
    s.add_group("both", ["t*"])
    return s


def view(s):
    return s.traits(), s.groups(), {t: sum(r.gradient for r in s.load_trait(t).collect()) for t in s.traits()}


@pytest.mark.parametrize("change", [lambda s: s.rename("t1", "t9"), lambda s: s.remove("t1"), lambda s: s.write_trait("t1", s.load_trait("t2").select("ordinal", "gradient"), overwrite=True),
                                    lambda s: s.write_groups({}), lambda s: s.write_trait("t3", s.load_trait("t2").select("ordinal", "gradient"), parameters=(["base"], [1.0]))])
def test_a_writer_lost_before_its_commit_leaves_the_old_state(store, spark, monkeypatch, change):
    before = view(store)

    def lost(self, name, text):
        raise KeyboardInterrupt("lost")

    with monkeypatch.context() as m:
        m.setattr("locusflow.sources.store._Folder.add", lost)
        with pytest.raises(KeyboardInterrupt):
            change(store)
    assert view(ScoreStore(spark, store.path)) == before
    change(store)
    assert view(store) != before


def test_of_two_writers_one_fails(store, spark, monkeypatch):
    other = ScoreStore(spark, store.path)
    seen = other._latest()
    store.rename("t1", "t8")
    monkeypatch.setattr(other, "_latest", lambda: seen)
    with pytest.raises(ConcurrentCommit):
        other.remove("t2")
    assert store.traits() == ["t2", "t8"] and store.groups() == {"both": ["t2", "t8"]}


def test_a_reader_keeps_its_state_until_vacuum(store):
    old = store.load_traits(["t1", "t2"])
    store.remove("t1")
    assert old.count() == 12 and store.traits() == ["t2"] and store.groups() == {}
    assert len(store.vacuum()) == 1 and store.load_trait("t2").count() == 6 and store.parameters("t2").first().value == 0.5


def test_rows_of_another_number_make_a_new_state(store, spark):
    rows = spark.createDataFrame([(0, "g", 0)], "ordinal long, gene_id string, jackknife_blocks int")
    with pytest.raises(FileExistsError):
        store.create(rows, "gene", ["gene_id"])
    store.replace_rows(rows, "gene", ["gene_id"])
    assert store.meta() == ("gene", ["gene_id"]) and store.traits() == [] and store.groups() == {} and store.rows().count() == 1


HEAD = ['##FORMAT=<ID=ES,Number=A>', '##FORMAT=<ID=SE,Number=A>', '##FORMAT=<ID=LP,Number=A>', '##FORMAT=<ID=NS,Number=A>', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"]


def vcf(tmp_path, rows, size=900, head=HEAD, end="\n"):
    path = str(tmp_path / "x.vcf.gz")
    lines = [f"{x}\n".encode() for x in [*head, *rows]]
    lines[-1] = lines[-1].rstrip(b"\n") + end.encode()
    bgzf.write_bgzf(iter(lines), path, size)
    return path


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [f"{'chr' if i % 2 else ''}{i % 23 + 1}\t{i}\trs{i}\tA\tC\t.\tPASS\t{'x' * rng.randrange(200)}\tES:SE:LP:NS\t{i}:2:1:{100 if i % 10 else 10}" for i in range(n)]


@pytest.mark.parametrize("size, split, end", [(900, 300, "\n"), (900, 1000, ""), (70, 64, "\n"), (60_000, 1 << 20, "\n"), (60_000, 5000, "")])
def test_every_line_is_read_once(tmp_path, size, split, end):
    """Ranges smaller and larger than blocks, blocks smaller and larger than lines."""
    rows = rows_of(300)
    path = vcf(tmp_path, rows, size, end=end)
    assert gzip.open(path, "rt").read() == "\n".join([*HEAD, *rows]) + end
    system, name = bgzf.file_system(path)
    with system.open_input_file(name) as f:
        got = [x for a in range(0, f.size(), split) for x in bgzf.lines_of(f, a, min(f.size(), a + split))]
    assert [x.decode() for x in got] == [*HEAD, *rows]


def test_reader_regions_and_first_rows(spark, tmp_path):
    rows = rows_of(500)
    path = vcf(tmp_path, rows, 5000)
    df = sumstats.read_sumstats(spark, path, split=500)
    assert df.rdd.getNumPartitions() > 5
    got = {r.ID: (r.CHR, r.POS, r.Z) for r in df.collect()}
    assert got == {f"rs{i}": (i % 23 + 1, i, i / 2) for i in range(500) if i % 10}
    some = sumstats.read_gwas_vcf(spark, path, chromosome=3, low=100, high=300, maximum_missingness=1.0, split=2000)
    assert sorted(r.POS for r in some.collect()) == [i for i in range(100, 300) if i % 23 == 2]
    assert sumstats.read_gwas_vcf(spark, path, num_rows=15, maximum_missingness=1.0).count() == 15
    with pytest.raises(ValueError, match="region"):
        sumstats.read_gwas_vcf(spark, "x.vcf", chromosome=3)


def test_odd_files(spark, tmp_path):
    two = vcf(tmp_path, rows_of(3), head=[*HEAD[:-1], HEAD[-1] + "\tT"])
    with pytest.raises(ValueError, match="exactly one sample"):
        sumstats.read_gwas_vcf(spark, two)
    odd = vcf(tmp_path, [*rows_of(3), "1\t5\tx\tA\tC\t.\tPASS\t.\tES:SE:LP:AF\t1:1:1:0.5"])
    with pytest.raises(Exception, match="AF"):
        sumstats.read_gwas_vcf(spark, odd).collect()
    empty = vcf(tmp_path, [])
    assert sumstats.read_gwas_vcf(spark, empty).count() == 0
    plain = str(tmp_path / "y.vcf.gz")
    with gzip.open(plain, "wt") as f:
        f.write("\n".join([*HEAD, *rows_of(30)]) + "\n")
    assert not bgzf.is_bgzf(plain) and sumstats.read_gwas_vcf(spark, plain).count() == 27
    raw = bytearray(open(vcf(tmp_path, rows_of(200)), "rb").read())
    raw[200] ^= 255
    (tmp_path / "z.vcf.gz").write_bytes(raw)
    with pytest.raises(Exception, match="damaged|invalid|incorrect|Error"):
        sumstats.read_gwas_vcf(spark, str(tmp_path / "z.vcf.gz")).collect()
