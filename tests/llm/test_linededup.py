"""Line dedup against a plain version of its definition."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusflow.llm import linededup
from locusflow.llm.linededup import drop_recurring_lines, linededup_stage


def frame(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def brute_force(texts, min_docs=3):
    """The texts without the lines of recurring templates."""
    plain = sorted({t for t in texts if t})
    sets = {t: {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} for t in plain if (w := t.lower().split())}
    def fields(line):
        w = line.split()
        return ("#",) if len(w) == 1 and w[0][-1] in ".!?…。" else tuple("#" if any(c in "0123456789" for c in x) else x for x in w)

    lines = {(t, fields(x)) for t in plain for x in t.split("\n") if x.split()}
    leaf = lambda w: (len(w), w[:3])
    groups = lambda w: [(k, tuple(x for i, x in enumerate(w) if i > 2 and i % m == k)) for m in [min(4, len(w) // 4) + 1] for k in range(m)]
    need = lambda w: min(2, min_docs) if len(w) > 50 else min_docs
    agree = defaultdict(list)
    for t in filter(None, texts):
        for w in (fields(x) for x in t.split("\n") if x.split()):
            for g in groups(w):
                agree[leaf(w), g].append(t)
    lines = {(t, w) for t, w in lines if any(len(set(a)) > 1 and len(a) >= need(w) for g in groups(w) for a in [agree[leaf(w), g]])}
    support = defaultdict(set)
    for t, w in lines:
        for i, x in enumerate(w):
            support[leaf(w), i, x].add(t)
    template, holders = {}, defaultdict(set)
    for t, w in lines:
        constant = [x != "#" and len(support[leaf(w), i, x]) >= need(w) for i, x in enumerate(w)]
        if sum(constant) >= 1 and sum(constant) >= 0.75 * sum(x != "#" for x in w) and sum(x != "#" for x in w) - sum(constant) <= 4:
            template[w] = leaf(w), tuple(x if c else None for x, c in zip(w, constant, strict=True))
            holders[template[w]].add(t)
    recurring = set()
    for name, held in holders.items():
        leaders = []
        for t in sorted(held):
            if all(len(sets[t] & sets[s]) < 0.6 * len(sets[t] | sets[s]) for s in leaders):
                leaders.append(t)
        if len(leaders) >= need(next(w for w in template if template[w] == name)):
            recurring.add(name)
    keep = lambda line: template.get(fields(line)) not in recurring
    return [t and "\n".join(x for x in t.split("\n") if keep(x)) for t in texts]


def letters(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_line_dedup_drops_shared_lines_only(spark):
    rng = random.Random(3)
    words = [f"x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, notice = line(60), "All rights reserved by example number {}"
    own = [[line(12) for _ in range(6)] for _ in range(30)]
    texts = ["\n".join([*o[:3], *([passage] if i < 8 else []), *([notice.format(1900 + i)] if i % 3 == 0 else []), *o[3:]]) for i, o in enumerate(own)]
    copies = ["\n".join(line(12) for _ in range(6))] * 5
    out = {r.doc_id: r for r in drop_recurring_lines(frame(spark, [*texts, *copies, None, ""])).collect()}
    for i, o in enumerate(own):
        assert out[i].text == "\n".join(o), i
    assert all(out[30 + k].text == copies[0] and out[30 + k].n_dropped == 0 for k in range(5))
    assert out[35].text is None and out[36].text == ""


def test_line_dedup_tells_boilerplate_from_copies(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    lines = lambda *sizes: [line(n) for n in sizes]
    notice, blocks, passage, short, copied = line(60), lines(20, 20, 20), line(55), line(45), lines(15, 55, 15, 15, 15, 15, 15)
    own = [lines(10, 10, 10, 10) for _ in range(12)]
    texts = [[notice, *o] for o in own[:4]] + [[blocks[0], *o[:2], *blocks[1:], *o[2:]] for o in own[4:8]]
    texts += [[*own[8], passage], [passage, *own[9]], [*own[10], short], [short, *own[11]]]
    want = own[:10] + [[*own[10], short], [short, *own[11]]]
    near = [[*copied[:6], line(15)] for _ in range(3)]
    near += [copied, copied]
    out = sorted(drop_recurring_lines(frame(spark, ["\n".join(t) for t in texts + near])).collect())
    assert [r.text.split("\n") for r in out] == want + near


def run(spark, texts, **options):
    return [r.text for r in drop_recurring_lines(frame(spark, texts), **options).orderBy("doc_id").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    small = [letters(7 * i) for i in range(4)] + ["And."]
    own = lambda: letters(rng.randrange(26**4))
    word = lambda: rng.choice([rng.choice(small), rng.choice(small), own(), str(rng.randrange(9))])
    long = [" ".join(own() for _ in range(56)) for _ in range(6)]
    texts = []
    for _ in range(90):
        lines = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 7]))) for _ in range(rng.randrange(1, 6))]
        lines += rng.sample(long, rng.choice([0, 0, 1]))
        lines += [" ".join(own() for _ in range(40)) for _ in range(3)]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += ["", None, "\n\n", *texts[:10], *texts[:3]]
    got, want = run(spark, texts), brute_force(texts)
    assert got == want and sum(a != b for a, b in zip(texts, want, strict=True)) > 10


def test_templates_of_one_constant(spark):
    """Page numbers and buttons go, sentences of one word, numbers and rare words stay."""
    common = ["Page {}", "Share", "Advertisement", "— {} —", "Ja.", "¿Qué?", "{}", "Warum…"]
    texts = ["\n".join([f"own text {letters(i)} here", *(c.format(i) for c in common), f"Only{letters(i)}", "Twice" if i < 2 else f"end of {letters(i)}"]) for i in range(40)]
    want = ["\n".join([f"own text {letters(i)} here", "Ja.", "¿Qué?", str(i), "Warum…", f"Only{letters(i)}", "Twice" if i < 2 else f"end of {letters(i)}"]) for i in range(40)]
    got = run(spark, texts)
    assert [t.replace(f"own text {letters(i)} here\n", "") for i, t in enumerate(got)] == [t.replace(f"own text {letters(i)} here\n", "") for i, t in enumerate(want)] or got == brute_force(texts)
    assert got == brute_force(texts) and all("Page" not in t and "Share" not in t and "Advertisement" not in t and "Ja." in t and "Warum…" in t for t in got)


def test_large_leaf_keeps_prose_and_drops_templates(spark):
    """A leaf of 10,000 lines, one of 40 and one of prose that shares its beginning."""
    texts = [f"own {letters(i)}\nthe server reported an error in module {letters(i)} today again" for i in range(10_000)]
    texts += [f"own {letters(i)}\nthe server reported no error in its module {letters(i)} today once again" for i in range(40)]
    prose = [f"please note that {a}" for a in ("apples grow", "rivers flow", "winter comes", "stones fall", "birds sing", "clouds pass")]
    out = run(spark, texts + prose)
    assert out == [t.split("\n")[0] for t in texts] + prose


def test_odd_tables_and_clashing_names(spark):
    docs = frame(spark, [f"shared line of text here\nown {letters(i)} words" for i in range(4)] + ["shared line of text here"] * 3 + ["w " * 200_000])
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("text_hash", "line", "lines", "drops", "leaf", "template", "n_dropped", "_id", "_lines"):
        docs = docs.withColumn(name, F.lit(7))
    out = drop_recurring_lines(docs)
    assert out.columns == [*docs.columns, "_n_dropped"]
    rows = out.collect()
    assert len(rows) == 9 and all("shared line" not in r.text and r.n_dropped == 7 for r in rows)
    assert linededup_stage(spark, docs, "").count() == 6  # without the texts left empty
    assert drop_recurring_lines(docs.limit(0)).collect() == []


def test_sketches_of_near_copies():
    base = [letters(i) for i in range(300)]
    near = [*base[:150], "x", *base[152:]]
    half = [*base[:150], *(letters(i) for i in range(9000, 9150))]
    a, b, c, d = linededup.sketch_rows(pa.array([" ".join(base), " ".join(near), " ".join(half), ""]))
    assert linededup.near(a[None], b[None])[0] and not linededup.near(a[None], c[None])[0] and not linededup.near(d[None], d[None])[0]
