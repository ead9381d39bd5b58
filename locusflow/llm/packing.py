"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become token ids (byte-level BPE and an end id); only documents longer
than a sequence are cut, into whole sequences after a first, shorter piece.

Packing is best fit, decreasing, in bulk-synchronous supersteps on Spark.  Pieces of more
than half a sequence open one each; what they leave are the first gaps.  A superstep takes
the next classes of lengths, from the longest piece left down to ``STEP`` of it, and

1. range-sorts these pieces and all gaps by size, a gap before the pieces it just fits;
2. sweeps every range from the largest size down: a piece's successor is the smallest gap
   open at its place, equal sizes go by rank (the sort's order), and what a gap has left
   returns to the sweep.  In the first range a piece without a gap opens a sequence;
3. carries over the ranges' borders: the k-th piece that a range couldn't place goes, by
   its rank, to the k-th place of the gaps that the ranges before it have left, nearest
   range first.  The driver sees two numbers of each range, places are joined by rank;
4. updates the gaps.  Pieces without a place stay for the next superstep, before which as
   many sequences are opened as they need at least, beyond the places there are.

Inside a range the sweep is exactly sequential best-fit decreasing, and so is the result
where ``SWEEP`` rows hold all pieces and gaps.  Across borders what a gap has left is used in
the next superstep only, so a table of many ranges may need more sequences.  There are
about as many supersteps as steps from half a sequence to one token, whatever the table.

Defined results: null and empty texts are one piece holding the end id; repeated rows
are packed one by one; an empty table gives no rows; other columns are never read.
Ids are those of the tokenizer file, found from the rank file of the same vocabulary
where that gives them (``encoders``).  A very long text is encoded in one task, in
memory of its ids; its pieces are rows like others.
"""

from __future__ import annotations

import zlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, n_partitions, table
from .encoders import byte_bpe_ids

MAX_TOKENS = 1024
END_ID = 2
#: Rows of a range, and the shortest length of a superstep against its longest.
SWEEP, STEP = 1 << 15, 0.9
#: Rows of a swept range: pieces placed, pieces left and gaps.
PLACED, LEFT, GAP = 0, 1, 2
SWEPT = "kind int, id long, value int, seq long, offset int, part int, at long, places int"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def _pieces(most: int, end_id: int, with_ids: bool, tokenizer_path: str, ranks_path: str, pattern: str):
    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "piece", "start", "length", "crc", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = list(byte_bpe_ids(text or "", tokenizer_path, ranks_path, pattern))
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), most)):
                    part = raw[start: start + length]
                    for name, value in zip(out, (row, doc, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None), strict=True):
                        out[name].append(value)
                    row += 1
            kinds = {"row": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "crc": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))
    return run


def sweep(events, most: int, opens: bool):
    """(placed, left, gaps) of one range; ``events`` are (size, 0 of a gap or 1 of a piece, id)
    by falling size, gaps first.  Placed pieces are (id, length, sequence, offset), left ones
    (id, length); gaps are (sequence, size, places), the smallest first, where places say how
    many pieces of the ranges behind it a gap takes at least.  With ``opens`` a piece without a
    gap opens a sequence of its id."""
    open_, later = [], []  # gaps at or above the sweep, the smallest last; gaps below it
    placed, left, size = [], [], most
    for size, kind, i in events:
        while later and -later[0][0] >= size:
            free, seq = heappop(later)
            open_.append((-free, seq))
        if kind == 0:
            open_.append((size, i))
            continue
        if open_:
            free, seq = open_.pop()
        elif opens:
            free, seq = most, i
        else:
            left.append((i, size))
            continue
        placed.append((i, size, seq, most - free))
        free -= size
        if free >= size:
            open_.append((free, seq))
        elif free:
            heappush(later, (-free, seq))
    gaps = [(seq, free, free // size) for free, seq in reversed(open_)]
    return placed, left, gaps + [(seq, -free, 0) for free, seq in later]


def _swept(most: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        events = (e for batch in batches for e in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        placed, left, gaps = sweep(events, most, part == 0)
        places = np.array([g[2] for g in gaps], np.int64)
        rows = [(PLACED, i, n, seq, offset, part, None, None) for i, n, seq, offset in placed]
        rows += [(LEFT, i, n, None, None, part, k, None) for k, (i, n) in enumerate(left)]
        rows += [(GAP, seq, free, None, None, part, at, n) for (seq, free, n), at in zip(gaps, (np.cumsum(places) - places).tolist(), strict=True)]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        names = [c.split()[0] for c in SWEPT.split(", ")]
        for k in range(0, len(rows), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k: k + (1 << 14)], strict=True), kinds, strict=True)], names=names)
    return run


def carried(left: list[int], places: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(range, first, stop, from, at): the pieces first to stop - 1 that a range has left go to
    the places from ``at`` on of a range before it, the nearest with places first."""
    out, open_ = [], []
    for p, n in enumerate(left):
        first = 0
        while first < n and open_:
            q, at = open_[-1]
            k = min(n - first, places[q] - at)
            out.append((p, first, first + k, q, at))
            first += k
            open_[-1] = (q, at + k)
            if at + k == places[q]:
                open_.pop()
        if places[p]:
            open_.append((p, 0))
    return out


def _over_borders(swept: DataFrame, moves: list[tuple[int, int, int, int, int]], most: int, scratch: Scratch):
    """(placed, left, gaps) after the moves: pieces and places meet by range and rank, both unique."""
    spark = swept.sparkSession
    part, first, stop, source, at = (np.array(x, np.int64) for x in zip(*moves, strict=True))
    keys = (part << 40) + first

    @F.pandas_udf("source long, at long")
    def moved(p, k):
        import pandas as pd

        key = (p.to_numpy().astype(np.int64) << 40) + k.to_numpy()
        i = np.maximum(np.searchsorted(keys, key, side="right") - 1, 0)
        ok = (part[i] == key >> 40) & (first[i] <= k.to_numpy()) & (k.to_numpy() < stop[i])
        return pd.DataFrame({"source": np.where(ok, source[i], -1), "at": np.where(ok, at[i] + k.to_numpy() - first[i], -1)})

    taken: dict[int, int] = {}
    for _, lo, hi, q, t in moves:
        taken[q] = t + hi - lo
    ends = F.broadcast(spark.createDataFrame(list(taken.items()), "part int, taken long"))  # a row per range at most
    left = swept.where(F.col("kind") == LEFT).withColumn("to", moved("part", "at"))
    gaps = swept.where(F.col("kind") == GAP)
    places = gaps.join(ends, "part").where((F.col("places") > 0) & (F.col("at") < F.col("taken")))
    places = places.select(F.col("part").cast("long").alias("source"), F.col("id").alias("seq"), F.col("value").alias("free"), F.explode(F.sequence("at", F.least(F.col("at") + F.col("places"), "taken") - 1)).alias("at"))
    met = left.where("to.source >= 0").select("id", "value", "part", "to.source", "to.at").join(places, ["source", "at"])
    before = F.coalesce(F.sum("value").over(W.partitionBy("seq").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = scratch.save(met.select(F.lit(PLACED).alias("kind"), "id", "value", "seq", (most - F.col("free") + before).cast("int").alias("offset"), "part", "at", F.lit(None).cast("int").alias("places")))
    used = placed.groupBy(F.col("seq").alias("id")).agg(F.sum("value").cast("int").alias("used"))
    gaps = gaps.join(used, "id", "left").select("id", (F.col("value") - F.coalesce("used", F.lit(0))).alias("value")).where("value > 0")
    return placed, left.where("to.source < 0").select("id", "value"), gaps


def best_fit(pieces: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(row, seq, offset) of the pieces (row, length) of at most half a sequence, and of no
    others: a longer one opens the sequence of its row.  ``pieces`` is a saved table."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``most`` rows
    lengths = sorted((n for n in counts if n <= most // 2), reverse=True)
    pieces = pieces.select(F.col("row").alias("id"), F.col("length").alias("value").cast("int"))
    small = scratch.save(pieces.where(F.col("value") <= most // 2)) if lengths else None
    gaps = pieces.where((F.col("value") > most // 2) & (F.col("value") < most)).select("id", (most - F.col("value")).alias("value"))
    n_gaps = sum(n for size, n in counts.items() if most // 2 < size < most)
    left, n_left, top, opened, saved = small, 0, 0, 0, []
    while lengths or n_left:
        top = max([top, *lengths[:1]])
        rows = n_gaps + n_left + sum(counts[n] for n in lengths)
        low = 0 if rows <= SWEEP else int(top * STEP)
        now = [n for n in lengths if n > low]
        lengths = lengths[len(now):]
        rows -= sum(counts[n] for n in lengths)
        events = gaps.select("value", F.lit(0).alias("kind"), "id")
        if n_left:
            events = events.unionByName(left.select("value", F.lit(1).alias("kind"), "id"))
        if now:
            events = events.unionByName(small.where(F.col("value").between(now[-1], now[0])).select("value", F.lit(1).alias("kind"), "id"))
        order = [F.col("value").desc(), F.col("kind"), F.col("id")]
        ranges = max(1, min(n_partitions(spark), -(-rows // SWEEP)))
        swept = scratch.save(events.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_swept(most), SWEPT))
        saved.append(swept)
        seen = {(r.part, r.kind): r for r in swept.where(F.col("kind") != PLACED).groupBy("part", "kind").agg(F.count("*").alias("n"), F.sum("places").alias("places")).collect()}  # two rows a range
        of = lambda kind, field: [getattr(seen[p, kind], field) if (p, kind) in seen else 0 for p in range(ranges)]
        moves = carried(of(LEFT, "n"), of(GAP, "places"))
        n_left = sum(of(LEFT, "n")) - sum(m[2] - m[1] for m in moves)
        n_gaps = sum(of(GAP, "n"))
        if moves:
            placed, left, gaps = _over_borders(swept, moves, most, scratch)
            saved.append(placed)
        else:
            left, gaps = (swept.where(F.col("kind") == k).select("id", "value") for k in (LEFT, GAP))
        top = 0
        if n_left:
            top, least = left.agg(F.max("value"), F.min("value")).first()
            places = gaps.agg(F.coalesce(F.sum(F.floor(F.col("value") / top)), F.lit(0))).first()[0]
            if places < n_left:
                n = max(1, (n_left - places) // (most // least))
                gaps = gaps.unionByName(spark.range(n).select((-1 - opened - F.col("id")).alias("id"), F.lit(most).alias("value")))
                opened += n
                n_gaps += n
    if not saved:
        return spark.createDataFrame([], "row long, seq long, offset int")
    return spark.read.schema(SWEPT).parquet(*(t._scratch_path for t in saved)).where(F.col("kind") == PLACED).select(F.col("id").alias("row"), "seq", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) per piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.save(texts.mapInArrow(_pieces(max_tokens, end_id, with_ids, tokenizer_path, ranks_path, pattern), "row long, doc_id long, piece int, start long, length long, crc long, ids array<int>"))
    placed = pieces.join(best_fit(pieces, max_tokens, scratch), "row", "left")
    sequence, offset = F.coalesce("seq", "row").alias("sequence_id"), F.coalesce(F.col("offset").cast("long"), F.lit(0).cast("long")).alias("offset")
    return placed.select("doc_id", "piece", "start", "length", F.col("crc").alias("ids_crc32"), "ids", sequence, offset)


def _public_files() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False, **_public_files()).drop("ids")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document, with their ids."""
    return pack_documents(docs, **_public_files())
