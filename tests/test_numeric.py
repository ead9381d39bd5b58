import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions.numeric import ieee_div, jackknife_group, link, log10_two_sided
from locusflow.functions.ordinal import keep_first, with_ordinal


def test_division_is_ieee(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 1.0), (1.0, None)]
    got = [r.z for r in spark.createDataFrame(rows, "a double, b double").coalesce(1).select(ieee_div(F.col("a"), F.col("b")).alias("z")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 0.25 and got[4] is None and got[5] is None


@pytest.mark.parametrize(("n", "g"), [(7, 3), (10, 10), (5, 9), (100, 7)])
def test_jackknife_groups_are_contiguous_and_even(spark, n, g):
    got = [r.jk for r in spark.range(n).coalesce(1).select(jackknife_group(F.col("id"), n, g).alias("jk")).collect()]
    assert got == [k for k, p in enumerate(np.array_split(np.arange(n), min(g, n))) for _ in p]


def test_link_golden(spark):
    x = float(np.dot([1, 2, 3], [0.2, 0.3, 0.4]))
    h, s, _ = link(F.lit(x), 10.0)
    row = spark.range(1).select(h.alias("h"), s.alias("s")).first()
    assert row.h == pytest.approx(0.2127, abs=1e-4) and row.s == pytest.approx(0.0881, abs=1e-4)


def test_normal_tail():
    assert log10_two_sided(1.959963984540054) == pytest.approx(math.log10(0.05), abs=1e-9)
    assert log10_two_sided(40) == pytest.approx(-349.1369, abs=1e-3)


def test_ordinal_and_first(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("k\tv\n" + "".join(f"{i % 5}\t{i}\n" for i in range(50)))
    df = with_ordinal(spark.read.csv(str(tmp_path / "x.tsv"), sep="\t", header=True))
    assert [r.ordinal for r in df.orderBy("ordinal").collect()] == list(range(50))
    assert sorted(r.ordinal for r in keep_first(df, ["k"], ["ordinal"]).collect()) == [0, 1, 2, 3, 4]
