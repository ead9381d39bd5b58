"""Fill-in-middle, BPE round trips and alignment against plain forms and the libraries."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from locusflow.llm import align, bpe, encoders, infill, packing

DATA = "/root/testdata/sf0.001"
LONG = 2_000_000
FILES = {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a", "é", "é", "İstanbul", "ΣΑΣ", "don't WE'LL 'S", "<|endoftext|> x<|startoftext|>", "<P>", "a<M>b", "x ▁ y", "\x00\x1c\x85", "日本語 한글 😀👩‍👩‍👧", "Å ﬁ ǅ", "a" * 700, " \n\t" * 50, "1234567890" * 9, "ᛪ\U00016ea0 \U000323b0"]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sha(text):
    return sha256(text.encode()).hexdigest()


def plain_infill(doc, text):
    """The contract, unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(), st.integers(-5, 10**12))
def test_masks_cut_like_the_pattern(text, doc):
    got = infill.infill(text.encode(), doc, infill.Infill())
    assert (*got[:4], got[4].decode()) == plain_infill(doc, text)
    assert infill.restored(got[4], got[1], infill.Infill()).decode() == text


@given(st.integers(0, 2**300), st.data())
def test_nth_bit(mask, data):
    places = [i for i in range(mask.bit_length()) if mask >> i & 1]
    if places:
        k = data.draw(st.integers(0, len(places) - 1))
        assert infill.nth_bit(mask, k) == places[k]


def test_fill_in_middle_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id <"), (3, "twice"), (3, "twice"), (40, "é b" * LONG), (41, "<" * 50 + "S><" * 9)]
    docs = table_of(spark, rows).withColumn("form", F.lit(1)).withColumn("n", F.lit("x"))
    got = infill.restore(infill.fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2("restored", 256)).collect()
    want = [(d, *(r := plain_infill(d, t))[:4], sha(r[4]), sha(t or "")) for d, t in rows]
    assert Counter(map(tuple, got)) == Counter(want)
    assert infill.restore(infill.fill_in_middle(docs.limit(0))).count() == 0


def test_fill_in_middle_with_other_sentinels(spark):
    how = infill.Infill("<pre>", "<suf>", "<mid>", seed="7", transformed=100, suffix_first=100)
    got = infill.restore(infill.fill_in_middle(table_of(spark, [(i, f"some words {i} <P>") for i in range(40)]), how), how).collect()
    assert {r.form for r in got} == {"spm"} and all(r.restored == f"some words {r.doc_id} <P>" and r.output.startswith("<suf>") for r in got)


def naive_merges(symbols, ranks, products):
    symbols = list(symbols)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not found:
            return symbols
        rank, at = min(found)
        symbols[at: at + 2] = [products[rank]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(0, 1000))
def test_segment_tree_merges_the_leftmost_lowest_rank(symbols, seed):
    rng = random.Random(seed)
    pairs = list({(rng.randrange(8), rng.randrange(8)) for _ in range(14)})
    rng.shuffle(pairs)
    ranks, products = {p: k for k, p in enumerate(pairs)}, [4 + k % 4 for k in range(len(pairs))]
    want = naive_merges(symbols, ranks, products)
    merges = bpe.Merges(pairs, products)
    assert bpe.merge_all(list(symbols), merges.ranks, products) == want
    if symbols:  # side by side with its own beginnings
        rows = np.full((len(symbols), len(symbols)), (1 << 20) - 1, np.int64)
        for k in range(len(symbols)):
            rows[k, : k + 1] = symbols[: k + 1]
        ids, counts = merges.many(rows, np.arange(1, len(symbols) + 1))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [naive_merges(symbols[: k + 1], ranks, products) for k in range(len(symbols))]


def word_library():
    t = Tokenizer.from_file(WORD_FILE)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(text):
    return np.frombuffer(bpe._model(WORD_FILE).encode([text])[0], np.int32).tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" 'sStTrReELlDdmMvV\ń̇İΣσ<|>endoftx012"))))
def test_ids_are_the_librarys(text):
    assert ids_of(text) == word_library().encode(text, add_special_tokens=False).ids


def test_every_code_point_is_encoded_as_by_the_library():
    library, bad = word_library(), []
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}{c}'{c}1{c}S " for c in points[i: i + 500]) for i in range(0, len(points), 500)]
    for i, t in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        if ids_of(texts[i]) != t.ids:
            bad.append(i)
    assert not bad
    alone = [f"a{c}'S" for c in points[:0x3200]]
    assert [ids_of(t) for t in alone] == [t.ids for t in library.encode_batch(alone, add_special_tokens=False)]


def test_round_trip_of_all_documents_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = table_of(spark, [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, "twice"), (7, "twice")])
    long = table_of(spark, [(20_000, "a" * 200_000), (20_001, "é!" * 300_000), (20_002, " " * LONG), (20_003, "\n" * LONG), (20_004, "word " * 400_000)])
    docs = docs.unionByName(odd).unionByName(long)
    got = bpe.bpe_decode(bpe.bpe_encode(docs.withColumn("ids", F.lit(1)), WORD_FILE), WORD_FILE).collect()
    library = word_library()
    rows = docs.collect()
    want = library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    want = [(r.doc_id, sha(" ".join(map(str, w.ids))), library.decode(w.ids, skip_special_tokens=False)) for r, w in zip(rows, want, strict=True)]
    assert Counter((r.doc_id, sha(" ".join(map(str, r.ids))), r.decoded) for r in got) == Counter(want)
    assert bpe.bpe_encode(docs.limit(0), WORD_FILE).count() == 0


@pytest.mark.parametrize("unit", [" ", "\n", " \n", "a", "!", "́", "7"])
def test_very_long_runs_are_encoded_like_the_tokenizer_file(unit):
    text = (f"x {unit * LONG}"[:LONG]) + " end"
    assert encoders.byte_bpe_ids(text, **FILES) == Tokenizer.from_file(FILES["tokenizer_path"]).encode(text, add_special_tokens=False).ids


def test_very_long_texts_are_packed_and_pass_the_pipeline(spark, tmp_path):
    """2,000,000 blanks, line breaks, letters and marks, alone and within prose."""
    prose = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    texts = [unit * LONG for unit in (" ", "\n", "a", "!")] + [f"{prose} {i} {unit * LONG} end" for i, unit in enumerate((" ", "\n"))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    whole = Tokenizer.from_file(FILES["tokenizer_path"])
    want = {i: [*whole.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
    got: dict = {}
    for r in packing.pack_documents(docs, **FILES).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.ids))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in got.items()} == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert kept and kept <= {4, 5}


@pytest.mark.parametrize("n", [encoders.RUN - 1, encoders.RUN, encoders.RUN + 1])
def test_both_encoders_agree_around_the_bound(n):
    for unit in " \n\t \x1c":
        text = f"a{unit * n}b c"
        assert encoders.byte_bpe_ids(text, **FILES) == Tokenizer.from_file(FILES["tokenizer_path"]).encode(text, add_special_tokens=False).ids


def plain_alignment(texts):
    """The contract with dictionaries."""
    a = Tokenizer.from_file(FILES["tokenizer_path"])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    side_a, side_b = align.public_pair().sides()
    docs, count = [], Counter()
    for text in texts:
        text = text or ""
        x, y = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text)
        if not text or any(b"".join(s.bytes_of[i] for i in z) != (" " + text).encode() for s, z in ((side_a, x), (side_b, y))):
            docs.append(None)
            continue
        ends = [np.cumsum([len(s.bytes_of[i]) for i in z]).tolist() for s, z in ((side_a, x), (side_b, y))]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((x[i:k], y[j:m]))
            i, j = k, m
        links = Counter()
        for p, q in groups:
            for u in p:
                for v in q:
                    links[u, v] += 1
        docs.append((len(x), len(y), groups, links))
        count.update(links.keys())
    top = {}
    for (u, _), n in count.items():
        top[u] = max(top.get(u, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        digest = sha(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups))
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()), digest))
    return out, {(u, v, n, n == top[u]) for (u, v), n in count.items()}


@pytest.mark.parametrize("run, wide", [(align.RUN, align.WIDE), (3, 2)])
def test_alignment_is_that_of_dictionaries(spark, monkeypatch, run, wide):
    monkeypatch.setattr(align, "RUN", run)
    monkeypatch.setattr(align, "WIDE", wide)
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = documents + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (7, "twice"), (7, "twice"), (9, "0" * 4001), (9, "=" * 3001 + " x")]
    docs = table_of(spark, rows).withColumn("key", F.lit(1)).withColumn("at", F.lit("x"))
    numbers, pairs = align.align_tokenizers(docs, align.public_pair())
    want, want_pairs = plain_alignment([t for _, t in rows])
    got = numbers.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert Counter(map(tuple, got)) == Counter((d, *w) for (d, _), w in zip(rows, want, strict=True))
    assert {tuple(r) for r in pairs.collect()} == want_pairs


def test_alignment_of_long_texts_and_of_none(spark):
    rows = [(1, "word and more " * 60_000), (2, " " * LONG), (3, "\n" * 300_000), (4, "short")]
    got = {r.doc_id: r for r in align.align_tokenizers(table_of(spark, rows), align.public_pair())[0].collect()}
    want, _ = plain_alignment([rows[0][1], rows[3][1]])
    assert (got[1].n_a, got[1].n_b, got[1].n_groups, got[1].n_links, got[1].groups_sha256) == (*want[0][:4], want[0][6])
    side = align.public_pair().sides()
    for k in (2, 3):
        n = len(rows[k - 1][1]) + 1
        x = side[0].encode([rows[k - 1][1]])[0]
        assert sum(len(side[0].bytes_of[i]) for i in x) == n and got[k].n_a in (0, len(x)) and got[k].n_groups <= min(got[k].n_a, got[k].n_b)
    assert align.align_tokenizers(table_of(spark, rows).limit(0), align.public_pair())[0].count() == 0
