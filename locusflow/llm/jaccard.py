"""N-gram Jaccard self-join by a size-aware heavy-light join, and its components.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Two sets of
sizes n and m reach similarity t exactly if they share c(n, m) = ceil(t (n + m) / (1 + t))
elements.

1. Equal sets are collapsed first (size and two 64-bit sums identify a set); one
   representative, the smallest id, takes part from then on.
2. Small sets (light): each enumerates its subsets of the fixed sizes c(n, m).  Sets
   that share a subset of size c link if their sizes allow it, and then all of them
   link with the smallest set that has it: one edge each, nothing to verify.
3. Large sets (heavy): inverted lists over each set's prefix, its first
   n - ceil(t n) + 1 elements in one global order; similar sets meet in a list.  The
   order puts frequent elements last (a bounded table, found in a bounded sample; it is
   only an ordering: any order gives the same result).  Where two sets meet in their
   first common element, at places p and q, they share at most min(n - p, m - q)
   elements; members that no other member of their list can reach so are left out.
   An element that the sample shows in very many sets has its list dealt over several
   tasks.
4. Lists are scanned twice.  First every member is paired with the list's smallest
   member only.  Verified pairs give components.  Then, in lists that still hold
   several components, members of other components are compared with those of the
   largest, and with one another, in blocks by parity sketches, whose distance never
   exceeds the sets' difference; the survivors are verified on the full sets.  So no
   link between components is lost and pairs inside a group of copies are never
   spelled out.

The boundary between small and large minimises the estimated rows of both sides
(subsets against prefix elements times the mean list length), within a fixed limit
that keeps the subsets of one set few.

Defined results: null or blank texts have an empty set and are linked with nothing;
texts of fewer than n words have one element; rows with one id belong together, be
their texts alike or not; rows
with a null id are returned with a null component; an empty table gives no rows;
other columns of the input are never read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, components, hash_sample, maybe_in, n_partitions, table
from .hashing import distinct_by_row, mix, release_memory, releasing, shingles, slices, words

#: Similarity as a fraction of whole numbers.
NUM, DEN = 75, 100
#: The elements that go last in the order of prefixes: so many of the most frequent, found in
#: so many sets or more of so many sampled documents.
ORDER_KEEP, ORDER_FROM, ORDER_SAMPLE = 1 << 18, 3, 20_000
#: Light sets never have more elements than this.
LIGHT_MAX = 10
#: Members of one piece of a list, about.
_PIECE = 50_000
#: Lists of more members are not thinned out.
_THINNED = 256
_ROW_DOCS = 4096
_BLOCK = 2048
_SKETCH_BITS = 1024
_ENTRIES_PER_BUCKET = 700_000
_ROWS_TOGETHER = 40_000


def overlap_needed(n, m, num: int = NUM, den: int = DEN):
    """Common elements that two sets of n and m elements need."""
    return -((-num * (n + m)) // (den + num))


def prefix_length(n, num: int = NUM, den: int = DEN):
    return n + ((-num * n) // den) + 1


def subset_sizes(n: int, num: int = NUM, den: int = DEN) -> list[int]:
    """The sizes of common subsets by which a set of n elements can link."""
    partners = range(-(-num * n // den), den * n // num + 1)
    return sorted({c for m in partners if m > 0 and (c := overlap_needed(n, m, num, den)) <= min(n, m)})


def _sets(column: pa.Array, n: int):
    """Values and rows of the distinct shingles of every row, and the sets' sizes."""
    hashes, counts = words(column, lower=True)
    values, rows = distinct_by_row(*shingles(hashes, counts, n))
    return values, rows, np.bincount(rows, minlength=len(column))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _identity(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that, with its size, identify a set."""
    ends = np.cumsum(sizes)
    out = []
    for seed in (0x51, 0xA7):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(seed)), out=total[1:])
        out.append(total[ends] - total[ends - sizes])
    return out[0], out[1]


def _frequent(n: int):
    """Elements of two or more different sets of a batch."""
    def run(batches):
        for batch in batches:
            seen, parts = set(), []
            for _, column in slices(batch.column(0)):
                values, rows, sizes = _sets(column, n)
                fresh = np.zeros(len(column), bool)
                for i, key in enumerate(zip(*_identity(values, sizes), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                parts.append(values[fresh[rows]])
            value, times = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([_longs(value[times > 1]), pa.array(times[times > 1].astype(np.int64))], names=["token", "times"])
    return run


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def sketch_widths(sizes: np.ndarray) -> np.ndarray:
    """Sketch bits by set size: powers of two that don't saturate at the distances that matter."""
    return np.where(sizes <= _SKETCH_BITS * 3 // 2, _SKETCH_BITS, np.where(sizes <= _SKETCH_BITS * 6, 4 * _SKETCH_BITS, 16 * _SKETCH_BITS))


def _index(n: int, last, light: int, num: int, den: int):
    """Identity, prefix (of light sets: the whole set) and parity sketch of every set."""
    def run(batches):
        late = last.value
        for batch in batches:
            for start, column in slices(batch.column(1)):
                values, rows, sizes = _sets(column, n)
                starts = np.cumsum(sizes) - sizes
                first, second = _identity(values, sizes)
                ordered = values
                if len(late) and len(values):
                    at = np.minimum(np.searchsorted(late, values), len(late) - 1)
                    is_late = late[at] == values
                    if is_late.any():  # elements in order stay so: early ones, then late ones
                        ordered = values[np.argsort(rows * 2 + is_late, kind="stable")]
                keep = np.where(sizes <= light, sizes, np.minimum(prefix_length(sizes, num, den), sizes))
                place = np.arange(len(values)) - np.repeat(starts, sizes)
                prefix = _binary(ordered[place < np.repeat(keep, sizes)].tobytes(), np.concatenate([[0], np.cumsum(keep)]) * 8)
                width = sketch_widths(sizes)
                offsets = np.concatenate([[0], np.cumsum(width)])
                bit = (mix(values ^ np.uint64(0x3C)) & (np.repeat(width, sizes) - 1).astype(np.uint64)).astype(np.int64)
                odd = np.bincount(np.repeat(offsets[:-1], sizes) + bit, minlength=offsets[-1]) & 1
                sketches = _binary(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes(), offsets // 8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(column)), pa.array(sizes.astype(np.int64)), _longs(first), _longs(second), prefix, sketches], names=["doc_id", "n", "f1", "f2", "prefix", "sketch"])
    return run


class Sketches:
    """Parity sketches of several widths; of two, the wider is folded to the other's."""

    def __init__(self, blobs: list[bytes]):
        self.width = np.array([len(b) for b in blobs], np.int64)
        self.rows, self.place = {}, {}
        widths = [int(w) for w in np.unique(self.width)]
        own = {w: np.flatnonzero(self.width == w) for w in widths}
        data = {w: np.frombuffer(b"".join([blobs[i] for i in own[w]]), np.uint64) for w in widths}
        for w in widths:
            wide = [x for x in widths if x >= w]
            self.rows[w] = np.concatenate([np.bitwise_xor.reduce(data[x].reshape(len(own[x]), x // w, w // 8), axis=1) for x in wide])
            self.place[w] = np.full(len(blobs), -1)
            self.place[w][np.concatenate([own[x] for x in wide])] = np.arange(len(self.rows[w]))

    def apart(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """At most the size of the symmetric difference of the sets p and q."""
        out = np.zeros(len(p), np.int64)
        least = np.minimum(self.width[p], self.width[q])
        for w, rows in self.rows.items():
            at = np.flatnonzero(least == w)
            step = max(1, (4 << 20) // w)
            for s in range(0, len(at), step):
                k = at[s: s + step]
                out[k] = np.bitwise_count(rows[self.place[w][p[k]]] ^ rows[self.place[w][q[k]]]).sum(axis=1)
        return out


def _subsets(num: int, den: int):
    def run(batches):
        for batch in batches:
            key, size, doc, count = [], [], [], []
            for d, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                values = mix(np.frombuffer(blob, np.uint64))
                for c in subset_sizes(n, num, den):
                    picks = np.array(list(combinations(range(n), c)))
                    found = mix(values[picks].sum(axis=1, dtype=np.uint64) + np.uint64(c))
                    key.append(found.view(np.int64))
                    size += [c] * len(found)
                    doc += [d] * len(found)
                    count += [n] * len(found)
            keys = np.concatenate(key) if key else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(size, pa.int32()), pa.array(doc, pa.int64()), pa.array(count, pa.int64())], names=["key", "c", "doc", "n"])
    return run


def can_reach(n, p, m, q, num: int = NUM, den: int = DEN):
    """Whether sets of n and m elements can be similar if their first common element is at
    the places p and q, or later ones, given in thousandths of the size."""
    left = np.minimum(n - -(-n * p // 1000), m - -(-m * q // 1000))
    return left >= overlap_needed(n, m, num, den)


def _pieces(tokens: np.ndarray, late: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Over how many pieces the list of each element is dealt."""
    if not len(late) or not len(tokens):
        return np.ones(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
    return np.where(late[at] == tokens, pieces[at], 1)


def _pack(buckets: int, often, copies, num: int, den: int):
    """The prefix elements of a batch, dealt into buckets, one packed row each.  With
    ``copies`` (a bit filter) only sets that surely have no equal."""
    def run(batches):
        late, pieces = often.value
        for batch in batches:
            if copies is not None:
                batch = batch.filter(pa.array(~maybe_in(copies.value, batch.column(3).to_numpy())))
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            blobs = batch.column(2).to_pylist()
            held = np.array([len(b) // 8 for b in blobs], np.int64)
            rows = np.repeat(np.arange(len(docs)), held).astype(np.int32)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(held) - held, held)
            keep = place < prefix_length(sizes, num, den)[rows]
            tokens = np.frombuffer(b"".join(blobs), np.uint64)[keep]
            rows, place = rows[keep], (1000 * place[keep] // sizes[rows[keep]]).astype(np.uint16)
            piece = mix(docs.view(np.uint64))[rows] % _pieces(tokens, late, pieces).astype(np.uint64)
            bucket = (mix(tokens + piece) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tokens, rows, bucket, place = tokens[order], rows[order], bucket[order], place[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(bucket)]
            out = []
            for a, b in zip(cut, np.r_[cut[1:], len(bucket)][: len(cut)], strict=True):
                used, local = np.unique(rows[a:b], return_inverse=True)
                out.append((int(bucket[a]), tokens[a:b].tobytes(), local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), docs[used].tobytes(), sizes[used].astype(np.int32).tobytes(), place[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *[pa.array([x[i] for x in out], pa.binary()) for i in range(1, 6)]], names=["bucket", "tokens", "local", "docs", "sizes", "places"])
    return run


_LISTS = pa.schema([("token", pa.int64()), ("least", pa.int64()), ("least_n", pa.int64()), ("docs", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("star", pa.list_(pa.bool_()))])


def _lists(often, num: int, den: int):
    """Inverted lists with two members or more (or pieces of them), the smallest member
    beside each; ``star`` tells which members can reach it."""
    def run(rows: pa.Table) -> pa.Table:
        tokens, docs, sizes, places = [], [], [], []
        for t, i, d, n, p in zip(*(rows.column(c).to_pylist() for c in ("tokens", "local", "docs", "sizes", "places")), strict=True):
            t, d, n = np.frombuffer(t, np.uint64), np.frombuffer(d, np.int64), np.frombuffer(n, np.int32)
            i = np.frombuffer(i, np.uint16 if len(i) == 2 * len(t) else np.uint32)
            tokens.append(t)
            docs.append(d[i])
            sizes.append(n[i])
            places.append(np.frombuffer(p, np.uint16))
        if not tokens:
            return _LISTS.empty_table()
        tokens, docs, sizes, places = np.concatenate(tokens), np.concatenate(docs), np.concatenate(sizes).astype(np.int64), np.concatenate(places).astype(np.int64)
        order = np.lexsort((docs, tokens))
        tokens, docs, sizes, places = tokens[order], docs[order], sizes[order], places[order]
        parted = _pieces(tokens, *often.value) > 1
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        lengths = np.repeat(np.diff(np.r_[starts, len(tokens)]), np.diff(np.r_[starts, len(tokens)]))
        keep = parted | (lengths > _THINNED)
        small = np.flatnonzero(~keep & (lengths > 1))
        for i, j in pairs_of_lists(_run_lengths(tokens[small])):
            i, j = small[i], small[j]
            ok = can_reach(sizes[i], places[i], sizes[j], places[j], num, den)
            keep[i[ok]] = keep[j[ok]] = True
        tokens, docs, sizes, places = tokens[keep], docs[keep], sizes[keep], places[keep]
        if not len(tokens):
            return _LISTS.empty_table()
        lengths = _run_lengths(tokens)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(tokens)) - np.repeat(starts, lengths)
        first = np.repeat(starts, lengths)
        star = (place > 0) & can_reach(sizes, places, sizes[first], places[first], num, den)
        cut = np.flatnonzero(place % _ROW_DOCS == 0)
        offsets = pa.array(np.r_[cut, len(tokens)].astype(np.int32))
        release_memory()
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (docs, sizes, star)]
        return pa.table([pa.array(tokens[cut].view(np.int64)), pa.array(docs[first[cut]]), pa.array(sizes[first[cut]]), *lists], schema=_LISTS)
    return run


def _run_lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    return np.diff(np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)]) if len(x) else np.zeros(0, np.int64)


def pairs_of_lists(lengths: np.ndarray, most: int = 1 << 18):
    """Places (i, j), i < j, of all pairs inside consecutive lists, in pieces of about ``most``."""
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths > 1]):
        own = starts[lengths == n]
        if n * (n - 1) // 2 <= most:
            i, j = np.triu_indices(n, 1)
            step = max(1, most // len(i))
            for k in range(0, len(own), step):
                at = own[k: k + step, None]
                yield (at + i).ravel(), (at + j).ravel()
        else:
            for at in own:
                step = max(1, most // n)
                for k in range(0, n, step):
                    i, j = np.nonzero(np.arange(k, min(n, k + step))[:, None] < np.arange(n)[None, :])
                    yield at + k + i, at + j


def _compare(num: int, den: int):
    """Pairs of different components in the lists (block pairs of lists) of a bucket that
    their sketches allow."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("token", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("doc", "ascending")])
        token, lo, hi, doc, comp, n, block = (rows.column(c).to_numpy() for c in ("token", "lo", "hi", "doc", "comp", "n", "block"))
        sketches = Sketches(rows.column("sketch").to_pylist())
        new = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        found = [np.zeros((2, 0), np.int64)]
        for p, q in pairs_of_lists(np.diff(np.r_[new, len(token)])):
            ok = (comp[p] != comp[q]) & (den * np.minimum(n[p], n[q]) >= num * np.maximum(n[p], n[q])) & ((lo[p] == hi[p]) | (block[p] != block[q]))
            p, q = p[ok], q[ok]
            near = sketches.apart(p, q) <= n[p] + n[q] - 2 * overlap_needed(n[p], n[q], num, den)
            found.append(np.unique(np.stack([doc[p[near]], doc[q[near]]]), axis=1) if near.any() else found[0])
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        both = np.sort(both, axis=0)
        release_memory()
        return pa.table({"src": pa.array(both[0], pa.int64()), "dst": pa.array(both[1], pa.int64())})
    return run


def _whole_sets(n: int):
    def run(batches):
        for batch in batches:
            for start, column in slices(batch.column(1)):
                values, rows, sizes = _sets(column, n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(column)), pa.ListArray.from_arrays(offsets, _longs(values))], names=["doc", "els"])
    return run


def _verified(edges: DataFrame, texts: DataFrame, n: int, scratch: Scratch, num: int, den: int) -> DataFrame:
    """The edges (src, dst) whose whole sets are similar."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct()
    sets = texts.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(releasing(_whole_sets(n)), "doc long, els array<long>").dropDuplicates(["doc"])
    sets = scratch.save(sets)
    a = sets.select(F.col("doc").alias("src"), F.col("els").alias("a"))
    b = sets.select(F.col("doc").alias("dst"), F.col("els").alias("b"))
    both = edges.join(a, "src").join(b, "dst").withColumn("common", F.size(F.array_intersect("a", "b")))
    return scratch.save(both.where(den * F.col("common") >= num * (F.size("a") + F.size("b") - F.col("common"))).select("src", "dst"))


def light_boundary(sizes: dict[int, int], mean_list: float, num: int = NUM, den: int = DEN) -> int:
    """The largest size of light sets, by the rows that either side would make.

    ``sizes`` has the number of sets of each size up to a little over LIGHT_MAX.
    """
    def cost(x: int) -> float:
        subsets = sum(k * sum(comb(n, c) for c in subset_sizes(n, num, den)) for n, k in sizes.items() if n <= x)
        return subsets + sum(k * prefix_length(n, num, den) * mean_list for n, k in sizes.items() if den * n >= num * (x + 1))

    return min(range(LIGHT_MAX + 1), key=lambda x: (cost(x), x))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links are pairs of sets
    with den * intersection >= num * union."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    often = hash_sample(texts, ORDER_SAMPLE, ["doc_id"]).select("text").mapInArrow(releasing(_frequent(n)), "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= ORDER_FROM)
    often = sorted((np.int64(r.token).astype(np.uint64), r.times) for r in often.orderBy(F.desc("times"), "token").limit(ORDER_KEEP).collect())
    late = np.array([t for t, _ in often], np.uint64)
    times = np.array([k for _, k in often], np.float64)
    late_here = spark.sparkContext.broadcast(late)

    described = scratch.save(texts.mapInArrow(releasing(_index(n, late_here, LIGHT_MAX, num, den)), "doc_id long, n long, f1 long, f2 long, prefix binary, sketch binary"))
    sizes = scratch.save(described.select("doc_id", "n", "f1", "f2"))
    several = F.min(F.struct("n", "f1", "f2")) != F.max(F.struct("n", "f1", "f2"))
    if not sizes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(several.alias("several")).where("several").isEmpty():
        scratch.drop(described, sizes)
        return _components_by_row(texts, n, num, den, scratch)
    classes = scratch.save(sizes.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    limit = den * (LIGHT_MAX + 1) // num + 1
    spread = {r.n: r.k for r in classes.where(F.col("n") <= limit).groupBy("n").agg(F.count("*").alias("k")).collect()}
    elements, sets = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    light = light_boundary(spread, 1 + times.sum() / max(1, len(often)) / ORDER_FROM, num, den)
    pieces = np.maximum(1, np.ceil(times * max(1, sets / ORDER_SAMPLE) / _PIECE)).astype(np.int64)
    often = spark.sparkContext.broadcast((late, pieces))
    # one representative of each set: sets without an equal need no join to be told
    repeated = bit_filter(classes.where("copies > 1"), "f1")
    index = described.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "n", "prefix", "f1", "f2")
    # what passes the filter is joined with all classes that pass, for the filter also lets some sets without an equal pass
    reps = _with_copies(classes.select(F.col("rep").alias("doc"), "n", "f1", "f2"), repeated)
    chosen = _with_copies(index, repeated).join(reps, ["doc", "n", "f1", "f2"], "left_semi").select("doc", "n", "prefix", "f1").dropDuplicates(["doc", "n", "f1"])
    chosen = scratch.save(chosen)

    lonely = index.where(F.col("n") <= light).mapInArrow(_without(repeated), "doc long, n long, prefix binary")
    subsets = lonely.unionByName(chosen.where(F.col("n") <= light).select("doc", "n", "prefix")).mapInArrow(_subsets(num, den), "key long, c int, doc long, n long")
    subsets = scratch.save(subsets)
    least = subsets.groupBy("key", "c").agg(F.min(F.struct("n", "doc")).alias("least"), F.count("*").alias("k")).where("k > 1").select("key", "c", F.col("least.n").alias("ln"), F.col("least.doc").alias("least"))
    by_subset = subsets.join(least, ["key", "c"]).where((F.col("doc") != F.col("least")) & (num * (F.col("n") + F.col("ln")) <= (den + num) * F.col("c"))).select(F.col("doc").alias("src"), F.col("least").alias("dst")).distinct()

    buckets = max(n_partitions(spark), int(elements * (1 - num / den)) // _ENTRIES_PER_BUCKET + 1)
    large, packed = den * F.col("n") >= num * (light + 1), "bucket long, tokens binary, local binary, docs binary, sizes binary, places binary"
    heavy = index.where(large).select("doc", "n", "prefix", "f1").mapInArrow(releasing(_pack(buckets, often, repeated, num, den)), packed)
    heavy = heavy.unionByName(chosen.where(large).mapInArrow(releasing(_pack(buckets, often, None, num, den)), packed))
    listed = _lists(often, num, den)
    lists = scratch.save(heavy.groupBy("bucket").applyInArrow(lambda rows: listed(rows.drop_columns("bucket")), "token long, least long, least_n long, docs array<long>, ns array<long>, star array<boolean>"))
    members = lists.select("token", "least", "least_n", F.explode(F.arrays_zip("docs", "ns", "star")).alias("m")).select("token", "least", "least_n", F.col("m.docs").alias("doc"), F.col("m.ns").alias("n"), F.col("m.star").alias("star"))
    star = members.where("star").select(F.col("least").alias("src"), F.col("doc").alias("dst"), (F.col("n") + F.col("least_n")).alias("both")).distinct()
    sketch = described.select(F.col("doc_id").alias("doc"), "sketch").join(members.select("doc").distinct(), "doc", "left_semi")
    sketch = scratch.save(sketch.dropDuplicates(["doc"]))
    scratch.drop(described, chosen)
    star = star.join(sketch.select(F.col("doc").alias("src"), F.col("sketch").alias("sa")), "src").join(sketch.select(F.col("doc").alias("dst"), F.col("sketch").alias("sb")), "dst")
    star = scratch.save(star.select("src", "dst", "both", "sa", "sb").mapInArrow(_sketch_filter(num, den), "src long, dst long"))
    first = _verified(star, texts, n, scratch, num, den).unionByName(by_subset)
    known = scratch.save(components(spark, first, scratch))

    # lists of several components: their largest one against the others, and the others among themselves
    comp = members.join(known.withColumnRenamed("node", "doc"), "doc", "left").select("token", "doc", "n", F.coalesce("component", "doc").alias("comp"))
    comp = scratch.save(comp)
    scratch.drop(lists, subsets)
    mixed = comp.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("k"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda k: F.ceil(k / _BLOCK).cast("int")
    mixed = scratch.save(mixed.select("token", F.col("main.comp").alias("main"), F.col("main.k").alias("large"), (F.col("k") - F.col("main.k")).alias("others"), "comps").withColumn("a", blocks(F.col("large"))).withColumn("b", blocks(F.col("others"))))
    inside, end = F.col("comp") == F.col("main"), F.col("a") + F.col("b") - 1
    mine = F.when(inside, F.pmod(F.xxhash64("doc"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("doc"), F.col("b"))).cast("int")
    other = F.when(inside, F.sequence("a", end)).when(F.col("comps") > 2, F.sequence(F.lit(0), end)).otherwise(F.sequence(F.lit(0), F.col("a") - 1))
    dealt = comp.join(mixed, "token").withColumn("block", mine).join(sketch, "doc")
    dealt = dealt.withColumn("other", F.explode(other)).select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc", "comp", "n", "block", "sketch")
    entries = mixed.agg(F.sum(F.col("large") * F.col("b") + F.col("others") * (F.col("a") + F.col("b")))).first()[0] or 0
    compare, packs = _compare(num, den), max(n_partitions(spark), int(entries) // _ROWS_TOGETHER + 1)
    dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("token", "lo", "hi"), F.lit(packs)))
    rest = dealt.groupBy("pack").applyInArrow(lambda rows: compare(rows), "src long, dst long").distinct()
    rest = scratch.save(rest)
    second = _verified(rest, texts, n, scratch, num, den)
    final = components(spark, known.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(second), scratch)

    whole = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    return sizes.join(whole, ["n", "f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _components_by_row(texts: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The same where an id has rows of different sets: rows get ids of their own, and the
    ids that their components hold are linked in turn."""
    rows = scratch.save(texts.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    found = scratch.save(jaccard_components(rows.where("row IS NOT NULL"), n, num, den, "row").join(rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("own")), "doc_id"))
    least = found.groupBy("component_id").agg(F.min("own").alias("least"))
    linked = components(rows.sparkSession, found.join(least, "component_id").select(F.col("own").alias("src"), F.col("least").alias("dst")), scratch)
    whole = found.select(F.col("own").alias("doc_id"), "n_shingles").join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    # rows without an id are linked with nothing; only their sets are counted
    count = rows.where("row IS NULL").select("doc_id", "text").mapInArrow(releasing(_counted(n)), "doc_id long, n_shingles long")
    return whole.unionByName(count.withColumn("component_id", F.lit(None).cast("long")))


def _counted(n: int):
    def run(batches):
        for batch in batches:
            for start, column in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(column)), pa.array(_sets(column, n)[2].astype(np.int64))], names=["doc_id", "n_shingles"])
    return run


def _with_copies(index: DataFrame, repeated) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(repeated.value, batch.column("f1").to_numpy())))

    return index.mapInArrow(run, index.schema)


def _without(repeated):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~maybe_in(repeated.value, batch.column("f1").to_numpy()))).select(["doc", "n", "prefix"])
    return run


def _sketch_filter(num: int, den: int):
    def run(batches):
        for batch in batches:
            both = batch.column(2).to_numpy()
            sketches = Sketches(batch.column(3).to_pylist() + batch.column(4).to_pylist())
            apart = sketches.apart(np.arange(len(both)), np.arange(len(both)) + len(both))
            near = pa.array(apart <= both - 2 * overlap_needed(both, 0, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(near) for i in (0, 1)], names=["src", "dst"])
    return run


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id."""
    found = jaccard_components(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    return kept


OP4_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT i, doc_id, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT i, doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS p FROM d)),
n AS (SELECT i, doc_id, count(*) AS n FROM s GROUP BY i, doc_id),
o AS (SELECT a.i AS a, b.i AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM o JOIN n x ON a = x.i JOIN n y ON b = y.i WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id FROM d LEFT JOIN n USING (i) LEFT JOIN c ON c.a = d.doc_id
"""
