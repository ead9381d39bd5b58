"""URL filters: host rules first, then word segmentation and naive Bayes.

Rules are (host, path prefix) with a verdict; a rule fits its host and all subdomains,
and of the rules that fit the longest wins.  Urls without a rule are judged by a
multinomial naive Bayes over tokens: host labels are split into words by a unigram
Viterbi search (word counts from the titles of all pages, unknown words by length),
paths at non-alphanumerics, numbers become one token.  The classifier is fitted on all
tokens of a bounded sample of urls that rules decide.

Scale: the word counts stay a table.  The substrings of each different host label, of the
lengths that words have, are joined to it, and a label is searched with what it has found,
in time of its length and its finds, whatever that length is; hosts and pages then take
their words by joins that deal out labels and hosts which many rows have.

Defined results: a null url, or one without ``://``, has an empty host and path; with
nothing to fit on (no url under a rule of either kind) the verdict is allow; a host label
or title word of any length counts; repeated
rows are judged alike; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, spread_join, table

#: (verdict, host and path prefix)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Labelled urls of the fitting sample, about.
TRAIN_ROWS = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


#: Cost of a letter in an unknown word: ten letters to choose from.
_LETTER = log(10)


def likeliest_words(name: str, known: Iterable[tuple[int, int, int]], total: int) -> list[str]:
    """The split of ``name`` with the largest product of word probabilities; ``known`` has
    (start, end, count) of the known words in it.  Of equal ones, the longest last word.

    An unknown word costs by its length alone and never less than a known one, so the best
    start of one is carried along instead of being searched for at every end.
    """
    ending: dict[int, list[tuple[int, int]]] = {}
    for a, b, n in known:
        ending.setdefault(b, []).append((a, n))
    best, back, low, low_at = [0.0], [0], 0.0, 0
    for end in range(1, len(name) + 1):
        c, start = log(total) + _LETTER * end + low, low_at
        for a, n in ending.get(end, ()):
            c, start = min((c, start), (best[a] - log(n / total), a))
        best.append(c)
        back.append(start)
        if c - _LETTER * end < low:
            low, low_at = c - _LETTER * end, end
    out, end = [], len(name)
    while end:
        out.append(name[back[end]: end])
        end = back[end]
    return out[::-1]


def segmenter(counts: dict[str, int]) -> Callable[[str], list[str]]:
    """Splits a concatenated name into the likeliest words of a small table."""
    total, sizes = sum(counts.values()) or 1, sorted({len(w) for w in counts})
    found = lambda name: [(a, a + k, n) for k in sizes for a in range(len(name) - k + 1) if (n := counts.get(name[a: a + k]))]
    return lambda name: likeliest_words(name, found(name), total)


def _segmented(total: int):
    def run(batches):
        for batch in batches:
            words = [likeliest_words(label, [(r["a"], r["a"] + r["k"], r["n"]) for r in found or ()], total) for label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])
    return run


def host_words(hosts: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, words): the words of every different host in order, its last label at the end."""
    total, sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sort_array(F.collect_set(F.length("w")))).first()
    labels = hosts.select("host").distinct().select("host", F.posexplode(F.filter(F.split("host", "[^0-9a-z]+"), lambda x: x != "")).alias("at", "label"))
    labels = scratch.save(labels)
    names = labels.select("label").distinct().where(~F.col("label").rlike("^[0-9]+$"))
    fits = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda k: k <= F.length("label") - F.col("a"))
    parts = names.withColumn("a", F.explode(F.sequence(F.lit(0), F.length("label") - 1))).withColumn("k", F.explode(fits))
    known = parts.withColumn("w", F.substring("label", F.col("a") + 1, F.col("k"))).join(counts, "w").groupBy("label").agg(F.collect_list(F.struct("a", "k", "n")).alias("found"))
    split = names.join(known, "label", "left").mapInArrow(_segmented(max(1, total)), "label string, words array<string>")
    rest = F.when(F.col("label").rlike("^[0-9]+$"), "#").otherwise(F.col("label"))
    each = spread_join(labels, split, "label").select("host", "at", F.coalesce("words", F.array(rest)).alias("words"), "label")
    inside = F.transform(F.sort_array(F.collect_list(F.struct("at", "words", "label"))), lambda x: F.transform(x["words"], lambda w: F.concat(F.lit("h:"), w)))
    last = F.concat(F.lit("tld:"), F.max_by("label", "at"))
    return each.groupBy("host").agg(F.concat(F.flatten(inside), F.array(last)).alias("words"))


def path_tokens(path: str) -> list[str]:
    return [f"p:{'#' if x.isdigit() else x}" for x in re.split(r"[^0-9A-Za-z]+", path) if x]


def _tokens(batches):
    for batch in batches:
        tokens = [(w or []) + path_tokens(p) for w, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], names=["verdict", "tokens"])


def naive_bayes(rows: list, n_docs: dict[str, int]) -> dict:
    """Log-odds of blocking per token from (token, verdict, n) counts, and of the prior."""
    total = {v: 1.0 for v in ("allow", "block")}
    counts: dict[str, dict[str, int]] = {}
    for r in rows:
        counts.setdefault(r["token"], {})[r["verdict"]] = r["n"]
        total[r["verdict"]] += r["n"]
    size = len(counts) or 1
    p = lambda t, v: (counts[t].get(v, 0) + 1) / (total[v] + size)
    prior = log((n_docs.get("block", 0) + 1) / (n_docs.get("allow", 0) + 1))
    return {"prior": prior, "odds": {t: log(p(t, "block") / p(t, "allow")) for t in counts}}


def _scores(model):
    def run(batches):
        m = model.value
        odds = m["odds"]
        for batch in batches:
            words, paths, done = batch.column("words").to_pylist(), batch.column("path").to_pylist(), batch.column("rule").to_pylist()
            score = [None if r is not None else m["prior"] + sum(odds.get(t, 0.0) for t in (w or []) + path_tokens(p)) for w, p, r in zip(words, paths, done, strict=True)]
            verdict = [v if v is not None else "block" if s > 0 else "allow" for v, s in zip(batch.column("verdict").to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])
    return run


def title_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(w, n): all words of all titles (lower case, letters and digits) and their counts."""
    title = F.translate(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<title>(.*?)</title>", 1), _UPPER, _LOWER)
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n"))


def parsed_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): rule and verdict null where no rule fits."""
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, train_rows: int = TRAIN_ROWS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score (log-odds of block) where the model decides."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    parsed = scratch.save(parsed_urls(pages, rules, id_col, url_col))
    words = scratch.save(host_words(parsed, scratch.save(title_words(pages, html_col)), scratch))
    with_words = lambda rows: spread_join(rows, words, "host").select(*rows.columns, "words")
    sample = scratch.save(hash_sample(parsed.where("rule IS NOT NULL"), train_rows, ["page_id", "host", "path"]))
    tokens = with_words(sample).select("verdict", "words", "path").mapInArrow(_tokens, "verdict string, tokens array<string>")
    counts = tokens.select("verdict", F.explode("tokens").alias("token")).groupBy("token", "verdict").agg(F.count("*").alias("n")).collect()  # bounded by the sample
    docs = {r.verdict: r["count"] for r in sample.groupBy("verdict").count().collect()}
    model = naive_bayes(counts, docs) if len(docs) == 2 else {"prior": -1.0, "odds": {}}
    kind = dict(parsed.dtypes)["page_id"]
    return with_words(parsed).mapInArrow(_scores(spark.sparkContext.broadcast(model)), f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
