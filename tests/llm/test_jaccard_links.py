"""Links that a full filter or a repeated id must not lose."""

import random

from locusflow.llm import common, jaccard


def _found(spark, rows):
    return sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def _near(seed: str) -> tuple[str, str]:
    words = [f"{seed}{k}" for k in range(60)]
    return " ".join(words), " ".join([*words[:-1], "end"])


def test_links_of_sets_that_the_filter_of_copies_lets_pass(spark, monkeypatch):
    """A filter of 64 bits that the copies fill lets every set pass; those without an equal stay."""
    monkeypatch.setattr(jaccard, "bit_filter", lambda df, column: common.bit_filter(df, column, 64))
    copies = [(2 * k + j, " ".join(f"c{k}x{i}" for i in range(20))) for k in range(600) for j in (0, 1)]
    near = [(5000 + k, text) for k, text in enumerate([*_near("a"), *_near("b"), "s t u v w x y z q", "s t u v w x y z q r"])]
    assert _found(spark, copies + near) == [(i, i - i % 2) for i in range(1200)] + [(5000, 5000), (5001, 5000), (5002, 5002), (5003, 5002), (5004, 5004), (5005, 5004)]


def test_rows_of_one_id_with_different_texts_link_by_each(spark):
    (a, a2), (b, b2) = _near("a"), _near("b")
    rows = [(1, a), (2, a2), (2, b), (2, None), (3, b2), (4, "other words of no one else"), (None, a)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found) == sorted([(1, 56, 1), (2, 56, 1), (2, 56, 1), (2, 0, 1), (3, 56, 1), (4, 2, 4), (0, 56, 0)])


def test_the_stage_keeps_one_of_each_group_when_the_filter_is_full(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "bit_filter", lambda df, column: common.bit_filter(df, column, 64))
    docs = [(2 * k + j, " ".join(f"c{k}x{i}" for i in range(20))) for k in range(600) for j in (0, 1)] + [(5000 + k, text) for k, text in enumerate(_near("a"))]
    kept = jaccard.jaccard_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 1200, 2), 5000]


def test_the_stage_leaves_out_no_link_of_random_texts(spark, monkeypatch):
    """Copies with a few words changed, light and heavy, in lists cut into small pieces behind a full filter; by brute force."""
    for name, value in (("_PIECE", 20), ("_THINNED", 8), ("_BLOCK", 4), ("_ROW_DOCS", 8), ("_ENTRIES_PER_BUCKET", 500)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "bit_filter", lambda df, column: common.bit_filter(df, column, 64))
    rng, docs = random.Random(7), []
    for k in range(60):
        base = [f"w{rng.randrange(9)}" if k % 3 == 0 else f"u{k}x{rng.randrange(999)}" for _ in range(rng.choice([3, 6, 8, 9, 12, 16, 40, 120]))]
        for _ in range(rng.choice([1, 2, 4, 9])):
            docs.append((rng.randrange(1 << 40), " ".join(base)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = f"z{rng.randrange(99)}"
    sets = {i: {tuple(t.split()[p: p + 5]) for p in range(max(1, len(t.split()) - 4))} for i, t in docs}
    least = {i: i for i in sets}
    links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and 100 * len(x & y) >= 75 * len(x | y)]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    kept = jaccard.jaccard_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in least.values()})
