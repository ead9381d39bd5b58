"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are its bytes; a segment tree holds, for every pair of neighbours, rank
and place of its merge, and the smallest of every range.  The root is the lowest-rank
merge, leftmost among equals.  Merging takes one leaf away and changes the two beside it,
each a walk to the root, until the root says that no pair is left: n log n for a word of
n bytes, however long.  Short words that aren't known yet are merged many at a time, each
in its own tree, one merge a round.

Texts are cut at the added tokens' strings, normalised (NFC, lower case) and split into
words as the tokenizer file says.  Texts in NFC and in scripts whose character classes
agree between the two pattern engines are split first and normalised word by word, so
that a word's ids are found once (up to ``WORDS`` are remembered per worker); all others
take the file's own normaliser and splitter.  Both ways give the library's ids.

Defined results: null and empty texts have no ids and decode to an empty text; an added
token's string in a text is that token; repeated rows and null ids are treated row by
row; an empty table gives no rows; other columns are never read.  A very long text or
word costs some hundred bytes a symbol, in one task.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, table
from .encoders import byte_of_char, tokenizer

#: Remembered words per worker, and their longest length in characters; both change the speed alone.
WORDS, WORD_CHARS = 1 << 18, 64
#: Fixed values of the vocabulary: the mark of a word's end, and how words are split (after normalising).
WORD_END = "</w>"
_WORD = regex.compile(r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Beyond these blocks the engines' Unicode versions differ; U+0130 is the one letter whose lower case is no letter alone.
_OTHER = re.compile(r"[^\u0000-įı-՗֐-ࡿऀ-௿‐-⁩₠-₿←-⏿　-ヿ一-鿿가-힣]")
_NONE = 1 << 62
#: Words of up to so many bytes are merged side by side, each with its own tree; longer ones alone.
SIDE = 256


def merge_all(symbols: list[int], ranks: dict[int, int], products: list[int]) -> list[int]:
    """The symbols left when no pair can be merged; ``ranks`` by pair (first << 20 | second),
    ``products`` by rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    width, rank_of = 1 << (n - 2).bit_length(), ranks.get
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        if (rank := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None:
            tree[width + i] = rank * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != _NONE:
        rank, at = divmod(root, n)
        gone = after[at]
        right, left = after[gone], before[at]
        symbols[at] = product = products[rank]
        after[at] = right
        changed = [(at, _NONE)]
        if right < n:
            before[right] = at
            changed = [(gone, _NONE), (at, _NONE if (rank := rank_of(product << 20 | symbols[right])) is None else rank * n + at)]
        if left >= 0:
            changed.append((left, _NONE if (rank := rank_of(symbols[left] << 20 | product)) is None else rank * n + left))
        for leaf, value in changed:  # from the leaf to the root, or to where nothing changes
            i = width + leaf
            while i > 1:
                tree[i] = value
                beside = tree[i ^ 1]
                i >>= 1
                if beside < value:
                    value = beside
                if tree[i] == value:
                    break
            else:
                tree[1] = value
    out, at = [], 0
    while at < n:
        out.append(symbols[at])
        at = after[at]
    return out


class Merges:
    """Ranks and products of the merges, for one word or for many words side by side."""

    def __init__(self, pairs: list[tuple[int, int]], products: list[int]):
        self.ranks = {a << 20 | b: rank for rank, (a, b) in enumerate(pairs)}
        self.products = products
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self._keys, self._ranks = np.append(keys[order], 1 << 62), np.append(np.fromiter(self.ranks.values(), np.int64, len(self.ranks))[order], 0)
        self._products = np.array([*products, 0], np.int64)

    def _leaf(self, first: np.ndarray, second: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        key = first << 20 | second
        place = np.searchsorted(self._keys, key)
        return np.where(self._keys[place] == key, self._ranks[place] * n + at, _NONE)

    def many(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words given as rows of symbols, each with a tree of its own: in every
        round each word does the merge at its root, with the same point updates as alone."""
        words, n = symbols.shape
        if n < 2:
            return symbols.ravel(), lengths
        width = 1 << (n - 2).bit_length()
        tree = np.full((words, 2 * width), _NONE)
        pairs = self._leaf(symbols[:, :-1], symbols[:, 1:], np.arange(n - 1), n)
        tree[:, width: width + n - 1] = np.where(np.arange(1, n) < lengths[:, None], pairs, _NONE)
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        after, before = np.tile(np.arange(1, n + 1), (words, 1)), np.tile(np.arange(-1, n - 1), (words, 1))
        there = np.arange(n) < lengths[:, None]
        flat, row = tree.ravel(), np.arange(words)

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            i, base = width + leaf, rows * (2 * width)
            flat[base + i] = value
            for _ in range(width.bit_length() - 1):
                value = np.minimum(value, flat[base + (i ^ 1)])
                i = i >> 1
                flat[base + i] = value

        while len(row := row[tree[row, 1] != _NONE]):
            rank, at = np.divmod(tree[row, 1], n)
            gone = after[row, at]
            right, left, product = after[row, gone], before[row, at], self._products[rank]
            symbols[row, at], after[row, at], there[row, gone] = product, right, False
            ends = right >= lengths[row]
            r, a, x = row[~ends], at[~ends], right[~ends]
            before[r, x] = a
            put(r, gone[~ends], np.full(len(r), _NONE))
            put(r, a, self._leaf(product[~ends], symbols[r, x], a, n))
            put(row[ends], at[ends], np.full(int(ends.sum()), _NONE))
            inner = left >= 0
            r, x = row[inner], left[inner]
            put(r, x, self._leaf(symbols[r, x], product[inner], x, n))
        return symbols[there], there.sum(axis=1)


class WordBPE:
    """Encoder of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        char = {b: c for c, b in byte_of_char().items()}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char[b] + WORD_END] for b in range(256)], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile(f"({'|'.join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))})") if self.added else None
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.added.items()}}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        self.parts = tokenizer(path)
        self.known: dict[str | bytes | int, bytes] = {}

    def keys(self, text: str) -> list[str | bytes | int]:
        """What a text is made of: words as written, normalised pieces in bytes, added tokens' ids."""
        parts, out = self.cut.split(text) if self.cut else [text], []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part])
            elif part.isascii() or not (_OTHER.search(part) or not unicodedata.is_normalized("NFC", part)):
                out += _WORD.findall(part)
            else:
                byte = byte_of_char()
                out += [bytes(byte[c] for c in piece) for piece, _ in self.parts.pre_tokenizer.pre_tokenize_str(self.parts.normalizer.normalize_str(part))]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids (32 bits) of every text."""
        keys = [self.keys(t) for t in texts]
        found = [list(map(self.known.get, k)) for k in keys]
        missing = {k for ks, fs in zip(keys, found, strict=True) if None in fs for k, f in zip(ks, fs, strict=True) if f is None}
        learned = self._learn(list(missing))
        for ks, fs in zip(keys, found, strict=True):
            if None in fs:
                fs[:] = [learned[k] if f is None else f for k, f in zip(ks, fs, strict=True)]
        if len(self.known) + len(learned) > WORDS:
            self.known.clear()
        self.known.update((k, v) for k, v in learned.items() if isinstance(k, int) or len(k) <= WORD_CHARS)
        return [b"".join(fs) for fs in found]

    def _bytes(self, key: str | bytes) -> bytes:
        if isinstance(key, bytes):
            return key
        return (key.lower() if key.isascii() else self.parts.normalizer.normalize_str(key)).encode()

    def _learn(self, keys: list[str | bytes | int]) -> dict[str | bytes | int, bytes]:
        out: dict[str | bytes | int, bytes] = {k: k.to_bytes(4, "little") for k in keys if isinstance(k, int)}
        words = [(self._bytes(k), k) for k in keys if not isinstance(k, int)]
        classes: dict[int, list] = {}
        for raw, k in words:
            if len(raw) > SIDE:
                symbols = [*self.inner[np.frombuffer(raw[:-1], np.uint8)].tolist(), int(self.last[raw[-1]])]
                out[k] = np.array(merge_all(symbols, self.merges.ranks, self.merges.products), np.int32).tobytes()
            else:
                classes.setdefault(max(1, (len(raw) - 2).bit_length()) if len(raw) > 1 else 0, []).append((raw, k))
        for some in classes.values():
            most = max(1, (1 << 20) // max(len(raw) for raw, _ in some))
            for first in range(0, len(some), most):
                self._learn_side_by_side(some[first: first + most], out)
        return out

    def _learn_side_by_side(self, some: list[tuple[bytes, str | bytes]], out: dict) -> None:
        lengths = np.array([len(raw) for raw, _ in some])
        ends = np.cumsum(lengths)
        joined = np.frombuffer(b"".join(raw for raw, _ in some), np.uint8)
        flat = self.inner[joined]
        flat[ends - 1] = self.last[joined[ends - 1]]
        symbols = np.full((len(some), int(lengths.max())), (1 << 20) - 1, np.int64)
        symbols[np.arange(symbols.shape[1]) < lengths[:, None]] = flat
        ids, counts = self.merges.many(symbols, lengths)
        raw, at = ids.astype(np.int32).tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
        out.update((k, raw[a:b]) for (_, k), a, b in zip(some, at, at[1:], strict=False))


@lru_cache(maxsize=2)
def _model(path: str) -> WordBPE:
    return WordBPE(path)


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer_path)
        for batch in byte_slices(batches, 1, 1 << 21):
            packed = model.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the tokens' strings joined by spaces, since the file names no decoder."""
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _model(tokenizer_path).names
        for batch in byte_slices(batches, at):
            ends = batch.column(at).offsets.to_numpy().astype(np.int64)
            flat = batch.column(at).values.slice(ends[0], ends[-1] - ends[0])
            tokens = pa.LargeListArray.from_arrays(pa.array(ends - ends[0]), names.take(flat))
            texts = pc.binary_join(tokens, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{', '.join(f'`{k}` {v}' for k, v in encoded.dtypes)}, decoded string")


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    done = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
