"""Cross-tokenizer alignment by an event sweep.

Every token of either tokenizer is an event at the byte where it ends.  The events of
both sides are united, repartitioned by document and sorted by offset, and a state
machine streams through them: where both sides end at one byte a group closes, and all
pairs of an A and a B token inside it are links.  Its state is the open group, the
tokens read ahead of it, a running hash, and the document's different id pairs.

Events travel as runs of ``RUN`` tokens of one side (offset of the first byte, packed
ids): a token's end follows from the byte lengths of the ids.  Pairs of ids are counted
once per document.  The documents of a partition share most of their pairs, so counts
are summed per partition first, and corpus-wide counts go back to a partition once per
different pair, not once per document; no pair, however common, has more rows than there
are partitions.  Both ways stream, a partition's different pairs in memory.

Defined results: null and empty texts, and texts whose joined token bytes differ from
space and text on either side, have no tokens (zeros and an empty digest); repeated rows
and equal or null ids are documents of their own; an empty table gives no rows; other
columns are never read.  A very long text streams in runs; a group that stays open over
many tokens is paired by its different ids, with multiplicity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_slices, n_partitions, table
from .encoders import byte_bpe_ids, byte_of_char, tokenizer

#: Tokens of one event row.
RUN = 8192
#: Groups with more links than this are paired by different ids.
WIDE = 64


@dataclass(frozen=True)
class Side:
    """A tokenizer: texts to lists of ids, and the bytes of every id."""

    encode: Callable[[list[str]], list[list[int]]]
    bytes_of: list[bytes]

    def lengths(self) -> np.ndarray:
        return np.array([len(b) for b in self.bytes_of], np.int64)


@lru_cache(maxsize=2)
def byte_bpe_side(tokenizer_path: str, ranks_path: str, pattern: str) -> Side:
    """Space and text by the byte-level vocabulary, special strings as plain text."""
    byte, vocab = byte_of_char(), tokenizer(tokenizer_path, True).get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return Side(lambda texts: [byte_bpe_ids(" " + t, tokenizer_path, ranks_path, pattern, True) for t in texts], out)


@lru_cache(maxsize=2)
def piece_side(model_path: str) -> Side:
    """Text by the sentencepiece model, which puts the space before it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return Side(lambda texts: model.encode(texts, num_threads=1), [piece(i) for i in range(model.get_piece_size())])


@dataclass(frozen=True)
class Pair:
    """The two tokenizers, loaded once per worker from their files."""

    tokenizer_path: str
    ranks_path: str
    pattern: str
    model_path: str

    def sides(self) -> tuple[Side, Side]:
        return byte_bpe_side(self.tokenizer_path, self.ranks_path, self.pattern), piece_side(self.model_path)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 3)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


_EVENTS = "key long, doc_id long, at long, side int, ids binary"


def events(docs: DataFrame, pair: Pair) -> DataFrame:
    """Per document one row at -1, and per ``RUN`` tokens of a side one at its first byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = pair.sides()
        lengths = [s.lengths() for s in sides]
        for batch in byte_slices(batches, 2, 1 << 22):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column(2).to_pylist()]
            both = [side.encode(texts) for side in sides]
            for key, doc, text, *ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, *both, strict=True):
                rows.append((key, doc, -1, 0, b""))
                wanted = b" " + text.encode()
                if not text or any(b"".join([side.bytes_of[i] for i in x]) != wanted for side, x in zip(sides, ids, strict=True)):
                    continue
                for k in (0, 1):
                    x = np.array(ids[k], np.int64)
                    start = 0
                    for first in range(0, len(x), RUN):
                        part = x[first: first + RUN]
                        rows.append((key, doc, start, k, _packed(part.astype(np.uint16 if len(lengths[k]) <= 1 << 16 else np.uint32))))
                        start += int(lengths[k][part].sum())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["key", "doc_id", "at", "side", "ids"])

    return docs.mapInArrow(run, _EVENTS)


class _Open:
    """A document in the sweep: what is read ahead of the last closed group, and its sums."""

    def __init__(self, key: int, doc_id: int | None):
        self.key, self.doc_id = key, doc_id
        self.ends = [np.zeros(0, np.int64)] * 2
        self.ids = [np.zeros(0, np.int64)] * 2
        self.n, self.groups, self.links = [0, 0], 0, 0
        self.hash = sha256()
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def _counted(ids: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, group, times) of the different ids of every group, by group."""
    keys, times = np.unique(group * size + ids, return_counts=True)
    return keys % size, keys // size, times


def group_pairs(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, n: int, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, group, times) of the links of groups 0 to n - 1; ga and gb ascend."""
    ta, tb = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    if len(a) and len(b) and int((np.bincount(ga, minlength=n) * np.bincount(gb, minlength=n)).max()) > WIDE:
        a, ga, ta = _counted(a, ga, sizes[0])
        b, gb, tb = _counted(b, gb, sizes[1])
    nb = np.bincount(gb, minlength=n)
    each = nb[ga]
    where = np.repeat((np.cumsum(nb) - nb)[ga] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    return np.repeat(a, each) * sizes[1] + b[where], np.repeat(ga, each), np.repeat(ta, each) * tb[where]


class Sweep:
    """The state machine: takes sorted event rows, gives finished documents."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths = lengths
        self.sizes = (len(lengths[0]), len(lengths[1]))
        words = [f"{i}{end}" for end in (",", "|", ";", "") for i in range(max(self.sizes))]
        self.words = pa.array(words, pa.large_string())
        self.open: _Open | None = None

    def rows(self, rows: list[tuple]) -> list[_Open]:
        """One slice of rows; the last document stays open, the ones before it are returned."""
        docs = [self.open] if self.open else []
        new: list[list[list[np.ndarray]]] = [[[], []] for _ in docs]
        for key, doc, at, side, raw in rows:
            if at < 0:
                docs.append(_Open(key, doc))
                new.append([[], []])
            else:
                new[-1][side].append(_unpacked(raw, np.uint16 if self.sizes[side] <= 1 << 16 else np.uint32).astype(np.int64))
        if docs:
            self._close(docs, new)
            self.open = docs.pop()
        return docs

    def _close(self, docs: list[_Open], new: list[list[list[np.ndarray]]]) -> None:
        """Closes all groups whose common end has been read, of all documents at once."""
        ids, ends, owner = [], [], []
        for k in (0, 1):
            parts = [np.concatenate([d.ids[k], *n[k]]) for d, n in zip(docs, new, strict=True)]
            sizes = np.array([len(p) for p in parts])
            whole, who = np.concatenate(parts), np.repeat(np.arange(len(docs)), sizes)
            upto = np.cumsum(self.lengths[k][whole])
            before = np.concatenate([[0], upto])[np.cumsum(sizes) - sizes]
            base = np.array([d.ends[k][0] if len(d.ends[k]) else 0 for d in docs], np.int64)
            ids.append(whole)
            owner.append(who)
            ends.append(upto - before[who] + base[who] + (who << 44))
        (a, b), (ea, eb), (wa, wb) = ids, ends, owner
        at = np.searchsorted(ea, eb)
        common = (at < len(ea)) & (ea[np.minimum(at, len(ea) - 1)] == eb) if len(ea) else np.zeros(len(eb), bool)
        closes = np.zeros(len(ea), bool)
        closes[at[common]] = True
        ga, gb = np.cumsum(closes) - closes, np.cumsum(common) - common
        n = int(common.sum())
        na, nb = int(np.searchsorted(ga, n)), int(np.searchsorted(gb, n))
        last = docs[-1]
        for k, done in ((0, na), (1, nb)):
            last.ids[k] = ids[k][done:]
            last.ends[k] = np.array([(ends[k][done - 1] & ((1 << 44) - 1)) if done and owner[k][done - 1] == len(docs) - 1 else (last.ends[k][0] if len(last.ends[k]) else 0)], np.int64)
        if not n:
            return
        a, ga, wa, b, gb, wb = a[:na], ga[:na], wa[:na], b[:nb], gb[:nb], wb[:nb]
        of = wb[common[:nb]]  # document of every group
        ca, cb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        pair, group, times = group_pairs(a, ga, b, gb, n, self.sizes)
        most = self.sizes[0] * self.sizes[1]
        keys, times = _summed(of[group] * most + pair, times)
        starts = np.searchsorted(keys, np.arange(len(docs) + 1) * most)
        texts = self._texts(a, ga, b, gb, ca, cb, of, len(docs))
        sums = [np.bincount(w, weights=x, minlength=len(docs)).astype(np.int64) for w, x in ((wa, None), (wb, None), (of, None), (of, (ca * cb).astype(np.float64)))]
        for k, d in enumerate(docs):
            s = slice(starts[k], starts[k + 1])
            if s.start == s.stop:
                continue
            if d.groups:
                d.hash.update(b";")
                d.pairs, d.times = _summed(np.concatenate([d.pairs, keys[s] - k * most]), np.concatenate([d.times, times[s]]))
            else:
                d.pairs, d.times = keys[s] - k * most, times[s]
            d.hash.update(texts[k].as_buffer())
            d.n = [d.n[0] + int(sums[0][k]), d.n[1] + int(sums[1][k])]
            d.groups += int(sums[2][k])
            d.links += int(sums[3][k])

    def _texts(self, a, ga, b, gb, ca, cb, of, n_docs) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of the closed groups of every document."""
        n, size = len(ca), max(self.sizes)
        start = np.cumsum(ca + cb) - (ca + cb)
        ra, rb = np.arange(len(a)) - (np.cumsum(ca) - ca)[ga], np.arange(len(b)) - (np.cumsum(cb) - cb)[gb]
        final = np.concatenate([of[1:] != of[:-1], [True]]) if n else np.zeros(0, bool)
        code = np.empty(len(a) + len(b), np.int64)
        code[start[ga] + ra] = a + size * (ra == ca[ga] - 1)
        code[start[gb] + ca[gb] + rb] = b + size * np.where(rb < cb[gb] - 1, 0, np.where(final[gb], 3, 2))
        counts = np.bincount(of, weights=ca + cb, minlength=n_docs).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), self.words.take(pa.array(code)))
        return pc.binary_join(lists, pa.scalar("", pa.large_string()))


_SWEPT = {"key": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary()}


def _swept(pair: Pair):
    def finished(docs: list[_Open]) -> pa.RecordBatch:
        rows = [(d.key, d.doc_id, *d.n, d.groups, d.links, d.hash.hexdigest() if d.groups else "", _packed(np.diff(d.pairs, prepend=0)), _packed(d.times)) for d in docs]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SWEPT.values(), strict=True)], names=list(_SWEPT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(tuple(s.lengths() for s in pair.sides()))
        for batch in byte_slices(batches, 4, 1 << 20):
            if docs := sweep.rows(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                yield finished(docs)
        if sweep.open:
            yield finished([sweep.open])
    return run


def _pairs_of(row_pairs: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(row_pairs, np.int64))


def _part_counts(most: int = 1 << 20):
    """(part, pair, n): documents of a part that hold a pair, summed while the part goes on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n_held = None, [], 0
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def folded():
            fresh = np.concatenate([keys, *held])
            return _summed(fresh, np.concatenate([times, np.ones(len(fresh) - len(keys), np.int64)]))

        def row():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), pa.array(times)], names=["part", "pair", "n"])

        for batch in byte_slices(batches, 1, 1 << 20):
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    keys, times = folded()
                    if len(keys):
                        yield row()
                    part, held, n_held = p, [], 0
                    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
                held.append(_pairs_of(raw))
                n_held += len(held[-1])
                if n_held > most:
                    keys, times = folded()
                    held, n_held = [], 0
        keys, times = folded()
        if len(keys):
            yield row()
    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a part's counts (rows without a key come first), then its documents."""
    part, found, held = None, None, []
    for batch in byte_slices(batches, 5, 1 << 20):
        parts, of_count = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((parts[1:] != parts[:-1]) | (of_count[1:] != of_count[:-1])) + 1
        out, best, sums = [], [], []
        for lo, hi in zip([0, *turns], [*turns, len(parts)], strict=True):
            if parts[lo] != part:
                part, found, held = parts[lo], None, []
            rows = batch.slice(lo, hi - lo)
            if of_count[lo]:
                held.append([rows.column(k).to_numpy() for k in (2, 3, 4)])
                continue
            if found is None:
                pair, n, top = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(pair)
                found, held = (pair[order], n[order], top[order]), []
            for key, raw, raw_times in zip(*(rows.column(k).to_pylist() for k in (1, 5, 6)), strict=True):
                times = _unpacked(raw_times, np.int64)
                at = np.searchsorted(found[0], _pairs_of(raw))
                out.append(key)
                best.append(int((times * found[2][at]).sum()))
                sums.append(int((times * found[1][at]).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(best, pa.int64()), pa.array(sums, pa.int64())], names=["key", "n_best", "count_sum"])


def align_tokenizers(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): per row its numbers and digest of groups, and per linked id pair
    (a_id, b_id, n_docs, best), ``best`` where n_docs is the highest of its A id."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark), n_partitions(spark)
    size_b = len(pair.sides()[1].bytes_of)
    texts = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    part = F.pmod(F.hash("key"), F.lit(n)).alias("part")  # the partition that repartition by key puts a row in
    sorted_events = events(texts, pair).repartition(n, "key").sortWithinPartitions("key", "at", "side")
    swept = scratch.save(sorted_events.mapInArrow(_swept(pair), ", ".join(f"{k} {'string' if t == pa.string() else 'binary' if t == pa.binary() else 'long'}" for k, t in _SWEPT.items())).withColumn("part", part))
    parts = scratch.save(swept.select("part", "pairs").mapInArrow(_part_counts(), "part int, pair long, n long"))
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a_id", F.expr(f"pair div {size_b}"))
    top = counts.groupBy("a_id").agg(F.max("n").alias("top"))
    counts = scratch.save(counts.join(top, "a_id").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")))
    nulls = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    back = parts.select("part", "pair").distinct().join(counts, "pair").select("part", *nulls(key="long"), "pair", "n", "best", *nulls(pairs="binary", times="binary"))
    own = swept.where("n_links > 0").select("part", "key", *nulls(pair="long", n="long", best="long"), "pairs", "times")
    scores = back.unionByName(own).repartition(n, "part").sortWithinPartitions("part", F.asc_nulls_first("key")).mapInArrow(_scored, "key long, n_best long, count_sum long")
    numbers = swept.drop("pairs", "times", "part").join(scores, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    numbers = numbers.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    pairs = counts.select(F.expr(f"pair div {size_b}").alias("a_id"), F.expr(f"pair % {size_b}").alias("b_id"), F.col("n").alias("n_docs"), (F.col("best") == 1).alias("best"))
    return numbers, pairs


def public_pair() -> Pair:
    import public_tokenizers

    return Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_pair())[0]
