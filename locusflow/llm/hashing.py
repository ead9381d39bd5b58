"""Vectorised hashing of whole batches of texts, used inside Arrow tasks.

Words are maximal runs of characters other than ASCII white space (0x20,
0x09-0x0D).  ASCII white space and A-Z never occur inside a multi-byte UTF-8
sequence, so everything here works on the UTF-8 bytes of a batch at once.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_SLICE_BYTES = 1 << 19


def release_memory() -> None:
    """Hands freed memory back to the system, so that an idle worker stays small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(task):
    """A mapInArrow function that hands memory back behind every batch and at its end."""
    def run(batches):
        for out in task(batches):
            yield out
            del out
            release_memory()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): bijective, every bit depends on all."""
    x = x.astype(np.uint64, copy=True)
    x += _ODD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_BASE = 0xD6E8FEB86659FD93
_BASE_INV = np.uint64(_inverse(_BASE))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWER_CACHE: dict[str, np.ndarray] = {}


def _cached_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWER_CACHE or len(_POWER_CACHE["up"]) < n:
        size = max(n, 1 << 16)
        _POWER_CACHE["up"] = _powers(size, _BASE)
        _POWER_CACHE["down"] = _powers(size, int(_BASE_INV))
    return _POWER_CACHE["up"], _POWER_CACHE["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = _SLICE_BYTES):
    """(first row, rows) of consecutive pieces of a column of about ``most`` bytes."""
    _, offsets = text_bytes(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, column.slice(start, stop - start)
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, digits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hash and start of every word of the rows that ``offsets`` bound, and whether it
    has a digit.  Words end at white space and at the end of their row."""
    inside = ~_SPACE[data]
    bound = np.zeros(len(data) + 1, dtype=bool)
    bound[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | bound[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | bound[1:])) + 1
    up, down = _cached_powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * down[starts]
    hashes = mix(value ^ (ends - starts).astype(np.uint64) * _ODD)
    if not digits:
        return hashes, starts, None
    seen = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum((data >= 0x30) & (data <= 0x39), out=seen[1:])
    return hashes, starts, seen[ends] > seen[starts]


def words(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of every row, and for each row the number of words."""
    data, offsets = text_bytes(column)
    hashes, starts, _ = word_spans(_LOWER[data] if lower else data, offsets, digits=False)
    return hashes, np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])


def _rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words: a combination with odd factors, mixed."""
    m = len(hashes) - n + 1
    value = np.full(m, np.uint64(n))
    for k in range(n):
        value += hashes[k: k + m] * np.uint64(pow(_BASE, 2 * k + 1, 1 << 64))
    return mix(value)


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row and the row of each.

    A row with fewer than n words but at least one has its whole sequence as its
    only shingle (its length is part of the hash); a row without words has none.
    """
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) >= n:
        value, at = _rolling(hashes, n), row[: len(hashes) - n + 1]
        whole = at == row[n - 1:]
        value, at = value[whole], at[whole]
    else:
        value, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        values, rows = [value], [at]
        for k in range(1, n):
            own = short[counts[short] == k]
            if len(own):
                values.append(_rolling(hashes, k)[ends[own] - k])
                rows.append(own)
        value, at = np.concatenate(values), np.concatenate(rows)
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
    return value, at


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and value; ``rows`` are in order."""
    values = values.copy()
    edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1], True]) if len(rows) else []
    for a, b in zip(edges, edges[1:], strict=False):
        values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]
