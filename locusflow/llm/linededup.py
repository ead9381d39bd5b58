"""Line deduplication with a log-template tree.

Every line becomes tokens; a token with a digit is a variable field.  A fixed-depth
tree sorts lines by token count and then by their first ``LEADING`` tokens (variable
fields count as equal).  The other places are dealt over so many groups that one of
them has no variable field, whichever places vary; lines are only compared with lines
that agree in a group, if ``needed`` lines do and not all are of one text.  Among these, the
token at a place is constant if lines of ``needed`` different texts have it there, and a
variable field otherwise; a line's template is what is left of it when its variable
fields are taken out.  A template has a constant at least, its constants are at least
``SHARE`` of the tokens without digits, and it has at most ``FIELDS`` variable fields
besides those with digits, so ``Page <number>`` and ``Share`` are templates.  A word
alone on its line that ends as a sentence does (``ENDS``) is prose and none: on the
documents of sf0.1 these are 1,149 of 89,115 lines, ``Les.`` or ``And.``, and all that
templates of one constant would take.

A template recurs if ``needed`` documents hold it of which no two are near copies:
``min_docs``, or two if the line has more than ``LONG`` tokens.  Its lines are dropped
from all documents.  Equal texts count once; near copies are texts of whose word
5-shingle minhashes (one permutation, 128 values) at least ``NEAR`` agree, which also
holds for two copies of similarity 0.75 of one original.  Different documents are
found greedily by text hash: the first, the first that is no near copy of it, and so on.

Scale: the leaves are never gathered.  Supports, templates and holders are joins and
partial aggregations; tokens are only written for lines that share a group (a bit
filter of fixed size spares most others), sketches only for texts that hold a template,
and texts that lose nothing aren't shuffled.  Holders are compared with one or two leaders each, never with one another.

Defined results: null text counts as empty and stays null; blank lines, sentences of
one word and lines of variable fields alone are never dropped; a line repeated inside one document counts
once; repeated rows and equal texts are treated alike; null ids are like others; an
empty table gives no rows; other columns pass through unread.  A very long text is parsed
in one task, some tens of bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, fresh_name, maybe_in, table
from .hashing import mix, releasing, shingles, slices, text_bytes, word_spans, words

MIN_DOCS = 3
#: Passages of more tokens recur from two documents on.
LONG = 50
LEADING, SHARE, FIELDS = 3, 0.75, 4
#: How a sentence ends.
ENDS = tuple(x.encode() for x in ".!?…。")
SKETCH, NEAR = 128, 0.5
SLOTS = 1 << 19
#: Bytes of text whose lines are parsed together.
_TOGETHER = 1 << 19
_DIGITS = np.uint64(7)


def _parsed(column: pa.Array):
    """Of every line with a word: row, number inside its row, tokens, key, leaf and groups (of
    ``FIELDS + 1`` places, 0 where a line has fewer; odd for long lines); and the token hashes (0: with a digit)
    with the place of each line's first."""
    data, offsets = text_bytes(column)
    breaks = np.flatnonzero(data == 0x0A)
    # a line starts with its row or after a line break
    starts = np.union1d(offsets[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1][row])
    hashes, begin, digit = word_spans(data, np.r_[starts, len(data)] if len(starts) else np.zeros(1, np.int64))
    lo = np.searchsorted(begin, starts)
    n = np.searchsorted(begin, np.r_[starts[1:], len(data)] if len(starts) else starts) - lo
    keep = np.flatnonzero(n > 0)
    for t in np.flatnonzero(n == 1):  # a word that is a sentence stands as a variable field
        if data[begin[lo[t]]: starts[t + 1] if t + 1 < len(starts) else len(data)].tobytes().rstrip(b"\t\n\v\f\r ").endswith(ENDS):
            digit[lo[t]] = True
    row, number, n, lo = row[keep], number[keep], n[keep], lo[keep]
    line = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - lo[line]
    token = np.where(digit, 0, (hashes >> np.uint64(33)).astype(np.int32) + 1).astype(np.int32)
    mark = mix(np.where(digit, _DIGITS, hashes) ^ mix(place.astype(np.uint64)))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mark, out=total[1:])
    size = mix(n.astype(np.uint64))
    key, leaf = mix((total[lo + n] - total[lo]) ^ size), mix((total[lo + np.minimum(n, LEADING)] - total[lo]) ^ size)
    most = np.minimum(FIELDS, (n * (1 - SHARE)).astype(np.int64)) + 1
    sums = np.zeros((len(n), FIELDS + 1), np.uint64)
    inner = np.flatnonzero(place >= LEADING)
    np.add.at(sums.ravel(), line[inner] * (FIELDS + 1) + place[inner] % most[line[inner]], mark[inner])
    which = np.arange(FIELDS + 1)
    groups = (mix(sums ^ mix(leaf)[:, None] ^ mix(which.astype(np.uint64))[None, :]) >> np.uint64(17)).astype(np.int64) * 2 + 2 + (n > LONG)[:, None]
    plain = np.r_[0, np.cumsum(token != 0)]
    groups = np.where((which[None, :] < most[:, None]) & (plain[lo + n] > plain[lo])[:, None], groups, 0)  # without a plain token no template
    return row, number, n, key.view(np.int64), leaf.view(np.int64), groups, token, lo


def _listed(groups: np.ndarray) -> pa.Array:
    """The groups of each line as a list."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((groups > 0).sum(axis=1))].astype(np.int32)), pa.array(groups[groups > 0]))


def _lines(batches):
    """(text_hash, line, key, groups) of every line with a word."""
    for batch in batches:
        for start, column in slices(batch.column(1), _TOGETHER):
            row, number, _, key, _, groups, *_ = _parsed(column)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(column)).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(key), _listed(groups)], names=["text_hash", "line", "key", "groups"])


def _tokens(shared):
    """(text_hash, n, key, leaf, groups, tokens) of the lines of which a group passes the filter, once a text."""
    def run(batches):
        for batch in batches:
            for start, column in slices(batch.column(1), _TOGETHER):
                row, _, n, key, leaf, groups, token, lo = _parsed(column)
                at = np.flatnonzero((maybe_in(shared.value, groups.ravel()).reshape(groups.shape) & (groups > 0)).any(axis=1))
                _, once = np.unique(np.stack([row[at], key[at]]), axis=1, return_index=True) if len(at) else (None, at)
                at = at[np.sort(once)]
                sizes = n[at]
                inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo[at], sizes)
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(token[inside]))
                hashes = batch.column(0).slice(start, len(column)).take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([hashes, pa.array(sizes.astype(np.int32)), pa.array(key[at]), pa.array(leaf[at]), _listed(groups[at]), tokens], names=["text_hash", "n", "key", "leaf", "groups", "tokens"])
    return run


def sketch_rows(column: pa.Array) -> np.ndarray:
    """One-permutation minhashes of every row's word 5-shingles (0: none in that range)."""
    value, row = shingles(*words(column, lower=True), 5)
    out = np.full(len(column) * SKETCH, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(out, row * SKETCH + (value >> np.uint64(57)).astype(np.int64), value)
    low = np.maximum((out & np.uint64(0xFFFF)).astype(np.uint16), 1)
    return np.where(out == np.uint64(0xFFFFFFFFFFFFFFFF), 0, low).astype(np.uint16).reshape(-1, SKETCH)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sketches in the rows of ``a`` and ``b`` are those of near copies."""
    some = ((a > 0) | (b > 0)).sum(axis=1)
    return ((a == b) & (a > 0)).sum(axis=1) >= np.maximum(1, NEAR * some)


def _sketches(holders):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(maybe_in(holders.value, batch.column(0).to_numpy())))
            for start, column in slices(batch.column(1), _TOGETHER):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(column)), pa.array([r.tobytes() for r in sketch_rows(column)], pa.binary())], names=["text_hash", "sketch"])
    return run


def _apart(batches):
    """The pairs (text_hash, leader, sketch, other) that are no near copies."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SKETCH) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["text_hash", "leader"]).filter(pa.array(~near(a, b)))


def line_templates(lines: DataFrame, texts: DataFrame, scratch: Scratch, min_docs: int) -> DataFrame:
    """(key, template, needed) of the lines that have a template which may recur."""
    needed = F.when(F.col("n") > LONG, min(2, min_docs)).otherwise(min_docs)
    tag = F.col("text_hash").bitwiseAND((1 << 32) - 1)
    shared = lines.select(F.explode("groups").alias("group"), tag.alias("tag")).groupBy("group").agg(F.min("tag").alias("a"), F.max("tag").alias("b"), F.count("*").alias("k"))
    enough = F.col("k") >= F.when(F.col("group") % 2 == 1, min(2, min_docs)).otherwise(min_docs)
    shared = scratch.save(shared.where(enough & (F.lit(min_docs < 2) | (F.col("a") != F.col("b")))).select("group"))
    maybe = scratch.save(texts.mapInArrow(releasing(_tokens(bit_filter(shared, "group"))), "text_hash long, n int, key long, leaf long, groups array<long>, tokens array<int>"))
    agree = maybe.select("key", F.explode("groups").alias("group")).join(shared, "group", "left_semi").select("key").distinct()
    # saved, so that the counts below start anew: joined in place, a common line's rows would stay in its task
    held = scratch.save(maybe.drop("groups").join(agree, "key", "left_semi"))
    # a line's content with its texts: how many, and the first and last
    per_text = held.groupBy("leaf", "key", "text_hash").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    keys = per_text.groupBy("leaf", "key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.count("*").alias("texts"), F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
    keys = scratch.save(keys.withColumn("needed", needed).withColumn("sure", F.col("texts") >= F.col("needed")))
    scratch.drop(maybe, shared, held)
    # a mark for each place and its token; contents of enough texts support all their marks, else each text counts
    # a content alone in its leaf recurs by itself or not at all
    shared_leaf = keys.groupBy("leaf").agg(F.count("*").alias("k")).where("k > 1").select("leaf")
    marks = F.transform("tokens", lambda t, i: F.when(t != 0, F.xxhash64("leaf", i, t)))
    keys = keys.select("leaf", "key", "n", "needed", "texts", "sure", "a", "b", F.filter(marks, lambda x: x.isNotNull()).alias("marks"))
    several = keys.join(shared_leaf, "leaf", "left_semi")
    owner = F.when(F.col("sure"), F.array(F.lit(None).cast("long"))).otherwise(F.array_distinct(F.array("a", "b")))
    spread = lambda rows: rows.select("needed", F.explode(owner).alias("t"), "marks").select("needed", "t", F.explode("marks").alias("mark"))
    is_sure = F.max(F.col("t").isNull()).alias("sure")
    of_two = spread(several.where("needed <= 2")).groupBy("mark").agg(F.min("t").alias("a"), F.max("t").alias("b"), is_sure, F.max("needed").alias("needed")).where("NOT sure AND needed = 2 AND a = b")
    of_more = spread(several.where("needed > 2")).groupBy("mark", "t", "needed").agg(F.lit(1)).groupBy("mark", "needed").agg(F.count("t").alias("texts"), is_sure).where("NOT sure AND texts < needed")
    rare = of_two.select("mark").unionByName(of_more.select("mark"))
    own = several.where("NOT sure").select("key", "leaf", F.explode("marks").alias("mark"))
    fields = own.join(rare, "mark").groupBy("leaf", "key").agg(F.count("*").alias("fields"), F.bit_xor("mark").alias("out"))
    whole = F.aggregate("marks", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    solid = keys.withColumn("plain", F.size("marks")).withColumn("all", whole).select("leaf", "key", "needed", "texts", "all", "plain").join(fields, ["leaf", "key"], "left")
    constant = F.col("plain") - F.coalesce("fields", F.lit(0))
    solid = solid.where((constant >= 1) & (constant >= SHARE * F.col("plain")) & (F.coalesce("fields", F.lit(0)) <= FIELDS))
    named = scratch.save(solid.select("key", "needed", "texts", F.xxhash64("leaf", F.col("all").bitwiseXOR(F.coalesce("out", F.lit(0).cast("long")))).alias("template")))
    may = named.groupBy("template").agg(F.sum("texts").alias("held"), F.max("needed").alias("needed")).where("held >= needed").select("template")
    return scratch.save(named.join(may, "template").select("key", "template", "needed"))


def recurring_templates(by_text: DataFrame, texts: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """Templates of ``by_text`` (template, needed, text_hash) that ``needed`` texts hold of
    which no two are near copies."""
    enough = by_text.groupBy("template", "needed").agg(F.count("*").alias("n")).where("n >= needed")
    left = scratch.save(by_text.join(enough.select("template"), "template", "left_semi"))
    done = left.where("needed <= 1").select("template").distinct()
    sketches = None
    for step in range(2, most + 1):
        if sketches is None:
            holders = left.select("text_hash").distinct()
            sketches = texts.mapInArrow(releasing(_sketches(bit_filter(holders, "text_hash"))), "text_hash long, sketch binary")
            sketches = scratch.save(sketches.join(holders, "text_hash", "left_semi").dropDuplicates(["text_hash"]))
        leaders = left.groupBy("template").agg(F.min("text_hash").alias("leader"))
        led = scratch.save(left.join(leaders, "template").where("text_hash <> leader"))
        pairs = led.select("text_hash", "leader").distinct().join(sketches, "text_hash").join(sketches.select(F.col("text_hash").alias("leader"), F.col("sketch").alias("other")), "leader")
        apart = scratch.save(pairs.select("text_hash", "leader", "sketch", "other").mapInArrow(_apart, "text_hash long, leader long"))
        after = scratch.save(led.join(apart, ["text_hash", "leader"]).drop("leader"))
        found = after.where(F.col("needed") == step).select("template").distinct()
        done, left = done.unionByName(found), scratch.save(after.where(F.col("needed") > step))
    return done


def recurring_lines(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, text_col: str = "text") -> DataFrame:
    """(text_hash, line, template) of the lines of recurring templates, by texts."""
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    lines = scratch.save(texts.mapInArrow(releasing(_lines), "text_hash long, line int, key long, groups array<long>"))
    templates = line_templates(lines, texts, scratch, min_docs)
    held = scratch.save(lines.select("text_hash", "line", "key").join(templates, "key").drop("key"))
    scratch.drop(lines)
    by_text = held.select("template", "needed", "text_hash").distinct()
    done = scratch.save(recurring_templates(by_text, texts, scratch, max(2, min_docs)))
    return held.join(done, "template", "left_semi").select("text_hash", "line", "template")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and ``n_dropped`` (or, if taken,
    a like name: the last column) beside it."""
    scratch = Scratch(docs.sparkSession)
    drops = recurring_lines(docs, scratch, min_docs, text_col)
    drops = scratch.save(drops.groupBy("text_hash").agg(F.collect_set("line").alias("lines")).select(F.struct("text_hash", "lines").alias("drops")))
    # texts whose slot loses no line are passed on as they are; at most SLOTS rows are broadcast
    slots = F.broadcast(scratch.save(drops.select(F.pmod("drops.text_hash", F.lit(SLOTS)).alias("slot")).distinct()))
    in_slot = F.pmod(F.xxhash64(docs[text_col]), F.lit(SLOTS)) == slots["slot"]
    name = fresh_name(docs.columns, "n_dropped")
    same = docs.join(slots, in_slot, "left_anti").withColumn(name, F.lit(0))
    some = docs.join(slots, in_slot, "left_semi")
    body, gone = some[text_col], drops["drops"]["lines"]
    # the same plan at every size: a sort-merge join
    joined = some.join(drops.hint("merge"), F.xxhash64(body) == drops["drops"]["text_hash"], "left")
    kept = F.filter(F.split(body, "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    text = F.when(gone.isNull(), body).otherwise(F.array_join(kept, "\n"))
    return same.unionByName(joined.select(*[text.alias(c) if c == text_col else some[c] for c in docs.columns], F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).alias(name)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_dropped").cast("long").alias("n_dropped"), "text")


def linededup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without recurring lines; those left without a word go."""
    out = drop_recurring_lines(docs)
    dropped = F.col(out.columns[-1])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dropped > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    gone = (dropped > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~F.coalesce(gone, F.lit(False))).select(*docs.columns)
