"""Secret scanning: fixed patterns, and a linear-chain CRF that adds spans.

The patterns (assignments, access keys, hex runs) always hold.  The CRF tags every token
of a line (words, and punctuation marks one by one) as secret begin, inside or outside.
Its features are a token's shape, length, character mix and variety, the words beside
it, and of the file its language and whether it names a credential.  Viterbi decodes
whole lines; a line is left out only if a bound over its tokens' weights shows that
"outside throughout" is its best tagging.

Training labels are the pattern matches in a bounded sample of documents.  So that the
CRF learns more than the patterns, each labelled line is also used with its secret drawn
anew in other alphabets, and so once more without the words and quotes that give it
away; lines with a long mixed token that no pattern knows are left out, since nobody has
said what it is.  Fitting maximises the regularised conditional likelihood
(forward-backward, Adagrad).  Spans that overlap a pattern's are not added.

Defined results: null text counts as empty; without a pattern match in the sample the
CRF adds nothing; repeated rows are scanned alike; a null id is carried through; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, table

#: Documents of the fitting sample, about, and labelled lines, at most.
SAMPLE_DOCS, SAMPLE_LINES = 20_000, 1_200
EPOCHS = 4
KINDS = ("assign", "access", "hex", "crf")
# The patterns and the least lengths of what they must match.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[\w+/=~-](?:[\w+/=~.-]*[\w+/=~-])?|[^\w\s]")
_HEXADECIMAL, _RUN = re.compile(r"[0-9a-fA-F]+"), re.compile(r"(.)\1+")
_MARKED = re.compile(r"[^\w\s.,]|" + "|".join(_KEYWORDS), re.I)
#: Alphabets in which secrets of training lines are drawn anew.
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789_-")
_O, _B, _I = 0, 1, 2
#: Tokens, and forms of tokens, whose weights a worker remembers.
_REMEMBERED = 50_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def value_spans(text: str) -> list[tuple[int, int]]:
    """Where the secrets of the pattern matches stand, without the words before them."""
    out = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(out + [m.span() for p in (_ACCESS, _HEX) for m in p.finditer(text)])


def _kind(c: str) -> str:
    return "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "."


class _Kinds(dict):
    """The kind of every character, for ``str.translate``."""

    def __missing__(self, c: int) -> str:
        self[c] = _kind(chr(c))
        return self[c]


_KINDS = _Kinds()


def _form(word: str) -> tuple[str, int, bool, bool]:
    """All that a token's own features look at: the kinds of its characters, how many
    different ones there are, whether it is hexadecimal and whether it is ASCII."""
    return word.translate(_KINDS), len(set(word)), len(word) >= 8 and _HEXADECIMAL.fullmatch(word) is not None, word.isascii()


def own_features(word: str) -> list[str]:
    """Names of the features of a token by itself."""
    form, different, hexadecimal, ascii_ = _form(word)
    n = len(form)
    changes = sum(a != b for a, b in zip(form, form[1:], strict=False))
    share = lambda k: 5 * form.count(k) // n
    return [
        "bias", f"shape={_RUN.sub(lambda m: m[1], form)[:6]}", f"length={min(n // 4, 12)}", f"digits={share('0')}", f"upper={share('A')}", f"lower={share('a')}", f"marks={share('.')}",
        f"different={min(different // 4, 8)}:{min(n // 8, 3)}", f"changes={min(changes // 2, 8)}:{min(n // 8, 3)}", f"mixed={n >= 12 and '0' in form and ('a' in form or 'A' in form)}", f"hex={hexadecimal}", f"ascii={ascii_}",
    ]


def _beside(word: str) -> str:
    """What a neighbour is: a mark, a word that names credentials, a number or another word."""
    if len(word) == 1 and not word.isalnum():
        return word
    low = word.lower()
    return next((k for k in _KEYWORDS if k in low), "number" if any(c.isdigit() for c in word) else "word")


def context_features(words: list[str], k: int) -> list[str]:
    """Names of the features of the words beside a token."""
    before = _beside(words[k - 1]) if k else "^"
    far = _beside(words[k - 2]) if k > 1 else "^"
    return [f"before={before}", f"far={far}", f"after={_beside(words[k + 1]) if k + 1 < len(words) else '$'}", f"sets={any(w in (':', '=', '=>') for w in words[max(0, k - 3): k])}"]


def file_features(text: str, lang: str | None) -> list[str]:
    low = text.lower()
    return [f"lang={lang}", f"named={any(k in low for k in _KEYWORDS)}"]


class Crf:
    """Weights of a linear chain over outside, begin, inside; outside stands at both ends."""

    def __init__(self, names: list[str] = ()):
        self.at = {name: k for k, name in enumerate(names)}
        self.w = np.zeros((3, len(self.at)))
        self.t = np.zeros((3, 3))
        self.t[_O, _I] = -1e9  # inside must follow begin or inside
        self.known: dict[tuple, tuple[np.ndarray, float]] = {}
        self.words: dict[str, float] = {}
        self.contexts: dict[frozenset, float] = {}

    def places(self, names: list[str]) -> list[int]:
        """Columns of the features that training has seen."""
        return [k for x in names if (k := self.at.get(x)) is not None]

    def gain(self) -> np.ndarray:
        """By how much each feature speaks for begin or inside."""
        return np.maximum(self.w[_B], self.w[_I]) - self.w[_O]

    def own(self, word: str) -> tuple[np.ndarray, float]:
        """Weights of a token by itself, and by how much it is rather begin or inside."""
        form = _form(word)
        if form not in self.known:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            at = self.places(own_features(word))
            self.known[form] = self.w[:, at].sum(axis=1), float(self.gain()[at].sum())
        return self.known[form]

    def gain_of(self, word: str) -> float:
        """The second part of ``own``, remembered by word."""
        if (found := self.words.get(word)) is None:
            found = self.own(word)[1]
            if len(self.words) < _REMEMBERED:
                self.words[word] = found
        return found

    def chain(self) -> tuple[float, float]:
        """What going on inside a run of begin and inside costs at least against outside, and
        what entering and leaving it costs beyond that."""
        inner = self.t[1:, 1:].max() - self.t[_O, _O]
        around = self.t[_O, _B] + self.t[1:, _O].max() - 2 * self.t[_O, _O]
        return float(inner), float(around - inner)

    def context_gain(self, line: str) -> float:
        """What context and file can add at most in favour of begin or inside, by the marks
        and credential words in the line."""
        marks = frozenset(x.lower() for x in _MARKED.findall(line))
        if marks not in self.contexts:
            best: dict[str, float] = {}
            for (name, k), gain in zip(self.at.items(), self.gain(), strict=True):
                kind, _, value = name.partition("=")
                beside = kind in ("before", "far", "after") and (value in ("word", "number", "^", "$", ".", ",") or value in marks)
                if beside or kind in ("lang", "named") or name == "sets=False" or (name == "sets=True" and marks & {":", "="}):
                    best[kind] = max(best.get(kind, 0.0), float(gain))
            if len(self.contexts) >= _REMEMBERED:
                self.contexts.clear()
            self.contexts[marks] = sum(best.values())
        return self.contexts[marks]

    def may_hold(self, words: list[str], more: float, inner: float, around: float) -> bool:
        """Whether some run of tokens could be worth tagging: else "outside throughout" is best."""
        gains = [self.gain_of(w) + more + inner for w in words]
        if not gains or max(gains) + around <= 0 and max(gains) <= 0:
            return False
        best = run = gains[0]
        for g in gains[1:]:
            run = g + (run if run > 0 else 0.0)
            best = run if run > best else best
        return best + around > 0

    def emit(self, words: list[str], file: list[int]) -> np.ndarray:
        more = [self.places(context_features(words, k)) for k in range(len(words))]
        return np.array([self.own(w)[0] for w in words]) + np.array([self.w[:, m].sum(axis=1) for m in more]) + self.w[:, file].sum(axis=1)

    def viterbi(self, e: np.ndarray) -> list[int]:
        score, back = self.t[_O] + e[0], []
        for row in e[1:]:
            every = score[:, None] + self.t
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + row
        tags = [int((score + self.t[:, _O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def fit(self, data, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-3) -> Crf:
        """``data``: (columns of each token, tags) of each line."""
        gw, gt = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(data)):
                features, tags = data[k]
                n = len(tags)
                e = np.stack([self.w[:, f].sum(axis=1) for f in features])
                a, b = np.zeros((n, 3)), np.zeros((n, 3))
                a[0] = self.t[_O] + e[0]
                for i in range(1, n):
                    a[i] = np.logaddexp.reduce(a[i - 1][:, None] + self.t, axis=0) + e[i]
                b[-1] = self.t[:, _O]
                for i in range(n - 2, -1, -1):
                    b[i] = np.logaddexp.reduce(self.t + (e[i + 1] + b[i + 1])[None, :], axis=1)
                z = np.logaddexp.reduce(a[-1] + b[-1])
                p = np.exp(a + b - z)
                dt = np.zeros((3, 3))
                chain = [_O, *tags, _O]
                for x, y in zip(chain, chain[1:], strict=False):
                    dt[x, y] += 1
                dt[_O] -= p[0]
                dt[:, _O] -= p[-1]
                dt -= np.exp(a[:-1, :, None] + self.t[None] + (e[1:] + b[1:])[:, None, :] - z).sum(axis=0)
                dt[_O, _I] = 0
                gt += dt * dt
                self.t += rate * dt / np.sqrt(gt)
                for f, q, y in zip(features, p, tags, strict=True):
                    d = -q
                    d[y] += 1
                    g = d[:, None] - decay * self.w[:, f]
                    gw[:, f] += g * g
                    self.w[:, f] += rate * g / np.sqrt(gw[:, f])
        return self


def _tagged(line: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    words, tags, last = [], [], None
    for m in _TOKEN.finditer(line):
        hit = next((x for x in spans if x[0] < m.end() and m.start() < x[1]), None)
        tags.append(_O if hit is None else _I if hit == last else _B)
        last = hit
        words.append(m[0])
    return words, tags


def labelled(text: str, lang: str | None):
    """(feature names of each token, tags) of training lines: those with a pattern match in
    three forms, and lines without that have a digit or come in every twentieth place."""
    file = file_features(text, lang)
    spans, at = value_spans(text), 0
    names = lambda words, file: [[*own_features(w), *context_features(words, k), *file] for k, w in enumerate(words)]
    for number, line in enumerate(text.split("\n")):
        own = [(max(0, a - at), b - at) for a, b in spans if a < at + len(line) and at < b]
        rng = random.Random(f"{line[:200]}:{number}")
        if own:
            words, tags = _tagged(line, own)
            yield names(words, file), tags
            for copy in range(6):
                letters = rng.choice(_ALPHABETS)
                redrawn = [w if t == _O else "".join(rng.choice(letters) for _ in range(rng.randrange(14, 49))) for w, t in zip(words, tags, strict=True)]
                if copy % 3 == 0:
                    yield names(redrawn, file), tags
                    continue
                plain = [k for k, (w, t) in enumerate(zip(words, tags, strict=True)) if t != _O or (w.lower() not in _KEYWORDS and w not in "\"'=:")]
                yield names([redrawn[k] for k in plain], [x for x in file if not x.startswith("named")] + ["named=False"]), [tags[k] for k in plain]
        elif line.strip() and (number % 20 == 0 or any(c.isdigit() for c in line)):
            words, tags = _tagged(line, [])
            if not any(len(w) >= 16 and "mixed=True" in own_features(w) for w in words):
                yield names(words, file), tags
        at += len(line) + 1


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, id_col: str = "doc_id") -> Crf:
    """A CRF fitted on at most ``sample_lines`` lines of about ``sample_docs`` documents
    (id, text, lang), half of them with a secret if there are so many.

    Documents and lines are taken by hash, so reruns agree however the table is laid out."""
    def cut(batches):
        for batch in batches:
            rows = [x for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in labelled(text or "", lang) if 0 < len(x[1]) <= 200]
            flat = [(["\t".join(f) for f in names], tags) for names, tags in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.list_(pa.string())), pa.array([x[1] for x in flat], pa.list_(pa.int32()))], names=["features", "tags"])

    found = hash_sample(docs, sample_docs, [id_col]).select("text", "lang").mapInArrow(cut, "features array<string>, tags array<int>").distinct()
    found = Scratch(docs.sparkSession).save(found.withColumn("hit", F.array_contains("tags", _B)))
    rows = [r for hit in (True, False) for r in found.where(F.col("hit") == hit).orderBy(F.xxhash64("features", "tags"), "tags").limit(sample_lines // 2).collect()]
    if not any(r.hit for r in rows):
        return Crf()
    split = [([f.split("\t") for f in r.features], r.tags) for r in rows]
    crf = Crf(sorted({x for names, _ in split for f in names for x in f}))
    return crf.fit([([crf.places(f) for f in names], tags) for names, tags in split])


def crf_spans(text: str, lang: str | None, crf: Crf, bounded: bool = True) -> list[tuple[int, int]]:
    """Spans that the CRF tags, as (start, end); ``bounded`` leaves out lines that can have none."""
    out, at, file, chain = [], 0, None, crf.chain()
    for line in text.split("\n"):
        words = _TOKEN.findall(line)
        if words and (not bounded or crf.may_hold(words, crf.context_gain(line), *chain)):
            found = list(_TOKEN.finditer(line))
            file = crf.places(file_features(text, lang)) if file is None else file
            begin = False
            for m, tag in zip(found, crf.viterbi(crf.emit(words, file)), strict=True):
                if tag == _B or (tag == _I and not begin):
                    out.append((at + m.start(), at + m.end()))
                elif tag == _I:
                    out[-1] = (out[-1][0], at + m.end())
                begin = tag != _O
        at += len(line) + 1
    return out


def scan_text(text: str, lang: str | None, crf: Crf | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Pattern spans, and all spans with those the CRF adds."""
    base = base_spans(text)
    found = crf_spans(text, lang, crf) if crf is not None and len(crf.at) else []
    added = [(a, 3, b) for a, b in found if not any(x < b and a < y for x, _, y in base)]
    return base, sorted(base + added)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", crf: Crf | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_crf, base, spans) of every document; base and
    spans are lists kind:start:end in code points."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("doc_id"))
    model = spark.sparkContext.broadcast(crf or train(rows))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        m = model.value
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                found = [scan_text(t or "", lang, m) for t, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                counts = [[sum(s[1] == k for s in spans) for _, spans in found] for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(2), *[pa.array(c, pa.int64()) for c in counts], pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(x) for _, x in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_crf long, base string, spans string")


def base_digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_crf")
