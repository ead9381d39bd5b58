"""Stupid-backoff language-model scores, computed relationally.

Words are lower-cased (A-Z).  A document's score is the sum over its words w after
their predecessors v (the first word follows the mark <s>) of

    log(c(v w) / c(v))            if the bigram occurs ``min_count`` times or more in all documents,
    log(alpha * c(w) / N)         otherwise,

natural logarithms, c counted over all documents (c(<s>): documents with a word), N
all words.  An n-gram seen once is this very text's own and so counts as unseen.

``relational_scores`` says this for any order in plain joins: exploded n-grams are
grouped and joined to the counts of each order.  Its shuffles take many times the
input's disk (README has the figures), so ``lm_scores``, the query's form, does the
bigram case with packed rows.

How it runs: exploded n-grams are pre-aggregated per slice of documents and dealt by
hash, packed, into buckets.  A bucket holds its part of the count tables together
with the exploded rows to join, and returns sums per document; words that need the
unigram table go through a second round of buckets.  N-grams too frequent for one
bucket never get there: the ``HOT`` most frequent words and bigrams of a bounded
sample are counted exactly over all documents, and this table, of fixed size, is
broadcast.  The sample decides only which way a row takes, not any count.

Defined results: null and blank texts have no words, score 0 and no mean; rows with
one id (null too) are scored together and give one row; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, hash_sample, n_partitions, table
from .hashing import mix, release_memory, releasing, slices, words

ALPHA, MIN_COUNT = 0.4, 2
#: Words, and bigrams, that take the broadcast way; documents sampled to find them.
HOT, SAMPLE = 1 << 16, 20_000
_NULL = -(1 << 63)
_COLD = np.uint64(1 << 63)
_TOKENS_PER_BUCKET = 1_500_000
#: Bytes of text whose n-grams are pre-aggregated together.
_TOGETHER = 6 << 20
_PACKED = "bucket long, kind int, a binary, b binary, c binary, d binary"


def _grams(column: pa.Array):
    """Hash of each word and of the one before it (0: <s>), and the row of each.

    Words are hashed in small pieces, which keeps the work arrays over bytes small."""
    parts = [(words(piece, lower=True), start) for start, piece in slices(column)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.concatenate([h for (h, _), _ in parts]) | _COLD  # 0 is left for <s>, and low values for codes
    counts = np.concatenate([c for (_, c), _ in parts])
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    before = np.zeros_like(hashes)
    if len(hashes):
        before[1:] = np.where(row[1:] == row[:-1], hashes[:-1], np.uint64(0))
    return before, hashes, row


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b)


def _frequent(kind_limit: int):
    """(kind, hash, n) of a batch: kind 1 words, 2 bigrams."""
    def run(batches):
        for batch in batches:
            for _, column in slices(batch.column(0)):
                before, word, _ = _grams(column)
                for kind, x in ((1, word), (2, _pair(before, word))):
                    value, n = np.unique(x, return_counts=True)
                    top = np.argsort(-n, kind="stable")[:kind_limit]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), kind, np.int32)), pa.array(value[top].view(np.int64)), pa.array(n[top])], names=["kind", "hash", "n"])
    return run


def _look(table_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in a sorted table, and whether it is there."""
    if not len(table_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table_, x), len(table_) - 1)
    return at, table_[at] == x


def _count_hot(hot):
    """Exact counts of the hot words and bigrams; kind 0: words (hash 0) and documents with a word (hash 1)."""
    def run(batches):
        tables = hot.value
        total = [np.zeros(len(t), np.int64) for t in tables]
        n = docs = 0
        for batch in batches:
            for _, column in slices(batch.column(0)):
                before, word, _ = _grams(column)
                n += len(word)
                docs += int((before == 0).sum())
                for t, sums, x in zip(tables, total, (word, _pair(before, word)), strict=True):
                    at, there = _look(t, x)
                    sums += np.bincount(at[there], minlength=len(t))
        kinds, hashes, counts = [0, 0], [0, 1], [n, docs]
        for kind, t, sums in zip((1, 2), tables, total, strict=True):
            some = np.flatnonzero(sums)
            kinds += [kind] * len(some)
            hashes += t[some].view(np.int64).tolist()
            counts += sums[some].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(hashes, pa.int64()), pa.array(counts, pa.int64())], names=["kind", "hash", "n"])
    return run


class Model:
    """The broadcast tables: hot words and bigrams with their counts, and totals."""

    def __init__(self, rows, alpha: float, min_count: int):
        by = {k: sorted((np.int64(r["hash"]).astype(np.uint64), r["n"]) for r in rows if r["kind"] == k) for k in (0, 1, 2)}
        self.n, self.docs = (dict((int(h), n) for h, n in by[0]).get(i, 0) for i in (0, 1))
        # code 0 is <s>
        self.words = np.array([0, *(h for h, _ in by[1])], np.uint64)
        self.word_n = np.array([self.docs, *(n for _, n in by[1])], np.float64)
        self.pairs = np.array([h for h, _ in by[2]], np.uint64)
        self.pair_n = np.array([n for _, n in by[2]], np.float64)
        self.alpha, self.min_count = alpha, min_count

    def unigram(self, n: np.ndarray) -> np.ndarray:
        return np.log(self.alpha * n / self.n)


def _row(bucket: int, kind: int, *parts) -> tuple:
    parts = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return (bucket, kind, *(parts + [b""] * (4 - len(parts))))


def _rows(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(2, 6)]]


_NAMES = ["bucket", "kind", "a", "b", "c", "d"]
_SUMS, _WORDS, _TO_HOT, _TO_COLD = 0, 1, 2, 3


def _cut(bucket: np.ndarray):
    """(bucket, slice) of the runs of a sorted array."""
    if not len(bucket):
        return []
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(edge, [*edge[1:], len(bucket)], strict=True)]


def _by_doc(docs: np.ndarray, score: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple]:
    """Packed sums (doc, score, words) dealt by document."""
    ids, at = np.unique(docs, return_inverse=True)
    total, count = np.bincount(at, score, len(ids)), np.bincount(at, n, len(ids)).astype(np.int64)
    bucket = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return [_row(b, _SUMS, ids[order][s], total[order][s], count[order][s]) for b, s in _cut(bucket[order])]


def _deal(model, buckets: int):
    """Scores of hot bigrams at once; all others packed for their bucket."""
    def run(batches):
        m: Model = model.value
        for batch in batches:
            for start, column in slices(batch.column(1), _TOGETHER):
                ids = batch.column(0).slice(start, len(column)).fill_null(_NULL).to_numpy().astype(np.int64)
                a, b, row = _grams(column)
                at, hot = _look(m.pairs, _pair(a, b))
                code_a, hot_a = _look(m.words, a)
                code_b, hot_b = _look(m.words, b)
                hot &= hot_a
                n = m.pair_n[at[hot]]
                enough = n >= m.min_count
                wait = ~hot
                wait[np.flatnonzero(hot)[~enough]] = True
                sure = ~wait
                n = m.pair_n[at[sure]]
                out = _by_doc(ids[row[sure]], np.log(n / m.word_n[code_a[sure]]), np.ones(int(sure.sum())), buckets)
                cold, n = np.unique(b[~hot_b], return_counts=True)
                bucket = (mix(cold) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                out += [_row(k, _WORDS, cold[order][s], n[order][s].astype(np.int32)) for k, s in _cut(bucket[order])]
                for kind, which in ((_TO_HOT, wait & hot_b), (_TO_COLD, wait & ~hot_b)):
                    x = np.where(hot_a, code_a.astype(np.uint64), a)[which]
                    y = (code_b if kind == _TO_HOT else b)[which].astype(np.uint64)
                    d = row[which]
                    bucket = (np.where(hot_a[which], mix(mix(x) + y), mix(x)) % np.uint64(buckets)).astype(np.int64)
                    order = np.lexsort((y, x, bucket))
                    x, y, d, bucket = x[order], y[order], d[order], bucket[order]
                    for k, s in _cut(bucket):
                        used, local = np.unique(d[s], return_inverse=True)
                        out.append(_row(k, kind, x[s], y[s].astype(np.uint32 if kind == _TO_HOT else np.uint64), local.astype(np.uint32 if len(used) > 65535 else np.uint16), ids[used]))
                yield pa.RecordBatch.from_arrays(_rows(out), names=_NAMES)
    return run


def _read(rows: pa.Table):
    for r in zip(*(rows.column(c).to_pylist() for c in _NAMES[1:]), strict=True):
        yield r


def _word_table(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words_, at = np.unique(np.concatenate([np.frombuffer(a, np.uint64) for a, _ in parts]), return_inverse=True)
    return words_, np.bincount(at, np.concatenate([np.frombuffer(b, np.int32 if len(b) * 2 == len(a) else np.int64) for a, b in parts]), len(words_)).astype(np.int64)


def _join_bigrams(model, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        m: Model = model.value
        out, counts, x, y, docs = [], [], [], [], []
        for kind, a, b, c, d in _read(rows):
            if kind == _SUMS:
                out.append(_row(0, _SUMS, a, b, c))
            elif kind == _WORDS:
                counts.append((a, b))
            else:
                x.append(np.frombuffer(a, np.uint64))
                y.append(np.frombuffer(b, np.uint32 if kind == _TO_HOT else np.uint64).astype(np.uint64))
                docs.append(np.frombuffer(d, np.int64)[np.frombuffer(c, np.uint16 if len(c) == 2 * len(x[-1]) else np.uint32)])
        # sums pass on to the bucket of their documents
        out = [(int(mix(np.frombuffer(r[2], np.uint64)[:1])[0] % np.uint64(buckets)), *r[1:]) for r in out]
        word, word_n = _word_table(counts)
        if len(word):
            mine = int(mix(word[:1])[0] % np.uint64(buckets))
            out.append(_row(mine, _WORDS, word, word_n))
        if x:
            x, y, docs = np.concatenate(x), np.concatenate(y), np.concatenate(docs)
            pair, at = np.unique(_pair(x, y), return_inverse=True)
            n = np.bincount(at, minlength=len(pair))[at]
            cold_x = x >= _COLD
            first = np.empty(len(x))
            first[~cold_x] = m.word_n[x[~cold_x].astype(np.int64)]
            first[cold_x] = word_n[_look(word, x[cold_x])[0]] if cold_x.any() else 0
            full = n >= m.min_count
            cold_y = y >= _COLD
            known = full | ~cold_y
            score = np.zeros(len(x))
            score[full] = np.log(n[full] / first[full])
            back = ~full & ~cold_y
            score[back] = m.unigram(m.word_n[y[back].astype(np.int64)])
            out += _by_doc(docs[known], score[known], np.ones(int(known.sum())), buckets)
            y, docs = y[~known], docs[~known]
            bucket = (mix(y) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            y, docs = y[order], docs[order]
            for k, s in _cut(bucket[order]):
                used, local = np.unique(docs[s], return_inverse=True)
                out.append(_row(k, _TO_COLD, y[s], local.astype(np.uint32), used))
        release_memory()
        return pa.table(_rows(out), names=_NAMES)
    return run


def _join_words(model, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        m: Model = model.value
        counts, docs, scores, sizes, ask = [], [], [], [], []
        for kind, a, b, c, _ in _read(rows):
            if kind == _SUMS:
                docs.append(np.frombuffer(a, np.int64))
                scores.append(np.frombuffer(b, np.float64))
                sizes.append(np.frombuffer(c, np.int64))
            elif kind == _WORDS:
                counts.append((a, b))
            else:
                ask.append((np.frombuffer(a, np.uint64), np.frombuffer(c, np.int64)[np.frombuffer(b, np.uint32)]))
        word, n = _word_table(counts)
        for y, d in ask:
            docs.append(d)
            scores.append(m.unigram(n[_look(word, y)[0]].astype(np.float64)))
            sizes.append(np.ones(len(d), np.int64))
        d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        ids, at = np.unique(d, return_inverse=True)
        total = np.bincount(at, np.concatenate(scores), len(ids)) if len(d) else np.zeros(0)
        size = np.bincount(at, np.concatenate(sizes), len(ids)).astype(np.int64) if len(d) else np.zeros(0, np.int64)
        release_memory()
        return pa.table({"doc": ids, "score": pa.array(total, pa.float64()), "n": pa.array(size, pa.int64())})
    return run


def lm_scores(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, score, mean_score) of every document by the model of all of them."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = "kind int, hash long, n long"
    sample = hash_sample(texts, SAMPLE, ["doc_id"]).select("text").mapInArrow(releasing(_frequent(HOT)), counted).groupBy("kind", "hash").agg(F.sum("n").alias("n"))
    sample = scratch.save(sample)
    tops = [np.sort(np.array([r["hash"] for r in sample.where(F.col("kind") == k).orderBy(F.desc("n"), "hash").limit(HOT - 1).collect()], np.int64).view(np.uint64)) for k in (1, 2)]
    hot = spark.sparkContext.broadcast(tops)
    rows = texts.select("text").mapInArrow(_count_hot(hot), counted).groupBy("kind", "hash").agg(F.sum("n").alias("n")).collect()  # at most 2 HOT rows
    model = Model(rows, alpha, min_count)
    buckets = max(n_partitions(spark), model.n // _TOKENS_PER_BUCKET + 1)
    model = spark.sparkContext.broadcast(model)
    joined, unigrams = _join_bigrams(model, buckets), _join_words(model, buckets)
    packed = texts.mapInArrow(releasing(_deal(model, buckets)), _PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: joined(t), _PACKED)
    sums = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: unigrams(t), "doc long, score double, n long").groupBy("doc").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))
    sums = scratch.save(sums)
    ids = texts.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc")).distinct()
    out = ids.join(sums, "doc", "left").select(F.when(F.col("doc") != _NULL, F.col("doc")).alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_words"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))


def relational_scores(docs: DataFrame, order: int = 3, alpha: float = ALPHA, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, score) by a model of any order: n-gram counts joined to exploded n-grams."""
    start = "<s>"  # no word: words begin with a blank here
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words_ = F.transform(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), lambda w: F.concat(F.lit(" "), w))
    padded = F.concat(F.array_repeat(F.lit(start), max(1, order - 1)), words_)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), padded.alias("p"))
    first = max(1, order - 1)
    tokens = texts.select("doc_id", "p", F.explode(F.when(F.size("p") > first, F.sequence(F.lit(first + 1), F.size("p")))).alias("i"))
    # g1..gn end at the word, c1..cn-1 before it
    grams = {f"g{k}": F.xxhash64(F.slice("p", F.col("i") - k + 1, k)) for k in range(1, order + 1)}
    before = {f"c{k}": F.xxhash64(F.slice("p", F.col("i") - k, k)) for k in range(1, order)}
    tokens = tokens.select("doc_id", *[c.alias(name) for name, c in {**grams, **before}.items()])
    starts = texts.where(F.size("p") > first).agg(F.count("*").alias("n"))
    total = tokens.agg(F.count("*")).first()[0]
    counts = {}
    for k in range(1, order + 1):
        own = tokens.groupBy(F.col(f"g{k}").alias("g")).agg(F.count("*").alias("n"))
        counts[k] = own.unionByName(starts.select(F.xxhash64(F.array_repeat(F.lit(start), k)).alias("g"), "n"))
    scored = tokens
    for name, k in [*((f"g{k}", k) for k in range(1, order + 1)), *((f"c{k}", k) for k in range(1, order))]:
        scored = scored.join(counts[k].select(F.col("g").alias(name), F.col("n").alias(f"n_{name}")), name).drop(name)
    value = F.log(F.lit(alpha) ** (order - 1) * F.col("n_g1") / total)
    for k in range(2, order + 1):
        value = F.when(F.col(f"n_g{k}") >= min_count, F.log(F.lit(alpha) ** (order - k) * F.col(f"n_g{k}") / F.col(f"n_c{k - 1}"))).otherwise(value)
    sums = scored.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(value).alias("score")).withColumnRenamed("doc_id", "_of")
    ids = texts.select("doc_id").distinct()
    return ids.join(sums, ids["doc_id"].eqNullSafe(sums["_of"]), "left").select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 3).alias("score"), F.round("mean_score", 5).alias("mean_score"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, CASE WHEN i = 1 THEN ' ' ELSE w[i - 1] END AS v, w[i] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT w, count(*) AS n FROM t GROUP BY w UNION ALL SELECT ' ', count(*) FROM t WHERE v = ' '),
b AS (SELECT v, w, count(*) AS n FROM t GROUP BY v, w),
x AS (SELECT t.doc_id, CASE WHEN b.n >= 2 THEN ln(b.n::DOUBLE / h.n) ELSE ln(0.4 * u.n::DOUBLE / (SELECT count(*) FROM t)) END AS s
  FROM t JOIN b ON t.v = b.v AND t.w = b.w JOIN u h ON t.v = h.w JOIN u ON t.w = u.w),
s AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, round(coalesce(s.s, 0.0), 3) AS score, round(s.s / s.n, 5) AS mean_score FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id
"""
