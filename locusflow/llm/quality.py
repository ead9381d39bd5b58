"""Quality rules as a short-circuit cascade (DataFrame expressions only).

Every rule is a cheap-to-state test over derived columns.  ``plan_cascade``
estimates on a bounded sample, saved once, what each rule costs (the time Spark takes
to evaluate it there beyond an empty rule) and how many rows it rejects, and orders the rules by
rejections per cost; ``cascade`` then evaluates them as one nested CASE, so a
rule runs only on rows that all earlier rules passed.  The order changes the
cost, never the verdict: a row is kept if no rule rejects it.

Defined results: a null text counts as empty; an empty text has no words and is
rejected by the length rule; repeated rows are judged alike, one by one; a null
id is carried through; other columns of the input are never read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, hash_sample, table

#: Rows of the bounded sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
_WINDOW = 8
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a Boolean column over the text features (null: not rejected)."""

    name: str
    rejects: Column


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, window: int = _WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash, put together from hashes of halves.  Texts without
    equal windows are told by counting distinct ones; in others, equal windows are neighbours
    once sorted.
    """

    def count(hashed: Column) -> Column:
        again = lambda s, i: ((i > 0) & (F.get(hashed, i - 1)["h"] == s["h"])) | F.coalesce(F.get(hashed, i + 1)["h"] == s["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(hashed, again), lambda s: s["i"]))
        covered = lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
        return F.aggregate(_let(starts, covered), F.lit(0), lambda a, x: a + x)

    def joined(size: int, body) -> Column:
        """``body`` of the hashes of all runs of ``size`` words."""
        if size == 1:
            return _let(F.transform(words, lambda w: F.xxhash64(w)), body)
        half = size // 2
        pair = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - (size - half)), F.slice(h, size - half + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))
        odd = lambda h: F.zip_with(pair(h), F.slice(words, half + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))
        return joined(half, lambda h: _let(pair(h) if size % 2 == 0 else odd(h), body))

    def counted(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(placed, count))

    return F.when(F.size(words) > window, joined(window, counted)).otherwise(0).cast("long")


#: Names of the features that rules are stated over.
FEATURES = ("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def feature_columns(text: Column, words: Column) -> dict[str, Column]:
    return {
        "text": text, "n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(words),
    }


def default_rules(f: dict[str, Column] | None = None) -> list[Rule]:
    """The production rules over features: columns of these names, or, to have a feature
    computed only where a rule needs it, the expressions themselves."""
    f = f or {name: F.col(name) for name in FEATURES}
    text = F.coalesce(f["text"], F.lit(""))
    return [
        Rule("too_short", f["n_words"] < 20),
        Rule("repeated_windows", 100 * f["n_repeat_words"] > 30 * f["n_words"]),
        Rule("symbols", f["n_symbols"] > F.greatest(F.lit(10), f["n_words"] / 10)),
        Rule("word_length", (f["word_chars"] > 12 * f["n_words"]) | (2 * f["word_chars"] < 5 * f["n_words"])),
        Rule("repeated_lines", (f["n_dup_lines"] > 3) & (2 * f["n_dup_lines"] > F.size(F.split(text, "\n", -1)))),
        Rule("shouting", F.length(F.regexp_replace(text, "[^A-Z!]", "")) > F.length(text) / 2),
    ]


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("words", text_words(F.col("text")))
    return out.select("doc_id", *[c.alias(name) for name, c in feature_columns(F.col("text"), F.col("words")).items()])


def plan_cascade(sample: DataFrame, rules: list[Rule], repeats: int = 3) -> list[tuple[Rule, float, float]]:
    """The rules as (rule, cost, share rejected), most rejections per cost first.

    ``sample`` (bounded, saved: its scan is cheap) only decides the order of evaluation.  The
    cost of a rule is the least time of a few runs, less that of a rule that does nothing, so
    neither the scan nor the start of a job counts; costs are rounded to the empty rule's time
    times powers of four, since smaller differences are noise.  Ties keep the given order, so
    reruns agree unless a cost lies at a boundary.
    """
    def timed(rejects: Column) -> tuple[float, int, int]:
        best = float("inf")
        for _ in range(repeats):
            began = time.perf_counter()
            n, hit = sample.agg(F.count("*"), F.count_if(F.coalesce(rejects, F.lit(False)))).first()
            best = min(best, time.perf_counter() - began)
        return best, n, hit

    timed(F.length("text") < 0)  # the first job of a table takes longer
    empty, *_ = timed(F.length("text") < 0)
    found = []
    for rule in rules:
        took, n, hit = timed(rule.rejects)
        cost = 4.0 ** max(0, round(log(max(took / empty - 1, 1), 4)))
        found.append((rule, cost, hit / n if n else 0.0))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects a row, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects, F.lit(rule.name)).otherwise(out)
    return out


def ordered_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules (over features) in the order of the cascade, by one saved sample."""
    rules = default_rules() if rules is None else rules
    scratch = Scratch(docs.sparkSession)
    sample = scratch.save(hash_sample(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), sample_rows, ["doc_id"]))
    bare = sample.withColumn("words", text_words(F.col("text")))
    # each rule's features are computed for it alone, so their cost is the rule's
    planned = plan_cascade(bare.select(*[c.alias(name) for name, c in feature_columns(F.col("text"), F.col("words")).items()]), rules)
    scratch.drop(sample)
    return [r for r, _, _ in planned]


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Features of every document, ``rejected_by`` (null if kept) and ``kept``.  A feature that
    is not selected from the result is computed only where the cascade comes to its rule."""
    order = ordered_rules(docs, rules, text_col, id_col, sample_rows)
    return features(docs, text_col, id_col).withColumn("rejected_by", cascade(order)).withColumn("kept", F.col("rejected_by").isNull())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's features are wanted of every row, so only the rules' other work (letters
    and lines) is short-circuited here; ``quality_stage`` stops at the first rejection."""
    judged = quality_filter(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects, with all their columns.  Features are computed
    inside the cascade, so a document is only looked at as far as its first rejection; its
    words are bound once, which also holds when the filter is pushed below projections."""
    order = [r.name for r in ordered_rules(docs)]

    def verdict(words: Column) -> Column:
        rules = {r.name: r for r in default_rules(feature_columns(F.col("text"), words))}
        return cascade([rules[name] for name in order])

    return docs.where(_let(text_words(F.col("text")), verdict).isNull())


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT row_number() OVER () AS rid, doc_id, t, ws, ls FROM l),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM g)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
f AS (SELECT doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines
  FROM g LEFT JOIN cov USING (rid)),
j AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > greatest(10, n_words / 10) OR word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words
    OR (n_dup_lines > 3 AND 2 * n_dup_lines > n_lines)
    OR length(regexp_replace(t, '[^A-Z!]', '', 'g')) > length(t) / 2) AS kept
FROM j
"""
