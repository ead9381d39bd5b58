"""The pipeline's stages, each judged on its own input by brute force."""

import duckdb

import corpus_pipeline
from locusflow.llm.quality import OP6_SQL

from .test_linededup import brute_force

DATA = "/root/testdata/sf0.001"


def _sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == columns
        kept[name] = docs.toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert set(kept["quality_rules"].doc_id) == {r[0] for r in con.sql(f"SELECT doc_id FROM ({OP6_SQL}) WHERE kept").fetchall()}
    good = kept["quality_rules"].sort_values("doc_id")
    want = {i: new for i, old, new in zip(good.doc_id, good.text, brute_force(good.text.tolist()), strict=True) if new == old or (new or "").split()}
    assert dict(zip(kept["line_dedup"].doc_id, kept["line_dedup"].text, strict=True)) == want
    before = {r.doc_id: _sets(r.text) for r in kept["line_dedup"].itertuples()}
    comp = {k: k for k in before}
    for _ in range(3):
        for a, x in before.items():
            for b, y in before.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert set(kept["jaccard_join"].doc_id) == {k for k, c in comp.items() if k == c}
    assert set(kept["source_mixing"].doc_id) <= set(kept["jaccard_join"].doc_id) and kept["source_mixing"].doc_id.value_counts().max() <= 3
    packed = kept["best_fit_packing"]
    assert set(packed.doc_id) == set(kept["source_mixing"].doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_run_ends_with_the_last_stage(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]


def test_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeats, an empty table."""
    prose = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    texts = [None, "", " \n", prose, prose, prose + " end", "x " * 9000, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(9000))]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 == 0 else "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, prose.upper().lower() + " other tail of this text", "en", "s", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("kind", "rank", "copy", "text_hash", "drops", "lines", "words", "prefix", "component_id", "_inside", "row_", "size"):
        docs = docs.selectExpr("*", f"1 AS `{name}`")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {None, 3, 7}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
