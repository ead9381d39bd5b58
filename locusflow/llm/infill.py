"""Fill-in-middle transformation by bit-parallel masks over big integers.

A text's bytes are mapped to class masks with ``bytes.translate`` and read as one binary
integer each, bit i for byte i: letters, and first bytes of code points.  A unit starts
at a first byte that isn't a letter after a letter, which is two shifts and a few Boolean
operations for the whole text; ``bit_count`` gives the number of units and of code
points, and the byte where the k-th unit starts is found by halving the integer.

Units are maximal runs of ASCII letters and single other code points.  Cuts and form are
drawn from a hash of seed and id, so reruns agree whatever the layout.  ``restore``
rebuilds the exact text from the output and its form.

Defined results: null and empty texts are plain with no unit and an empty output; texts
that hold a sentinel stay plain; a null id is hashed as an empty string; repeated rows
are treated alike; an empty table gives no rows; other columns are never read.  A very
long text costs its own size a few times over, in one task, and linear time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, table

_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_IS_LETTER = bytes(0x31 if b in _LETTERS else 0x30 for b in range(256))
_IS_FIRST = bytes(0x30 if b & 0xC0 == 0x80 else 0x31 for b in range(256))


@dataclass(frozen=True)
class Infill:
    """Sentinels before prefix, suffix and middle, seed, and shares in percent."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1"
    transformed: int = 90
    suffix_first: int = 20

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def unit_masks(raw: bytes) -> tuple[int, int]:
    """(bits where a unit starts, bits where a code point starts)."""
    if not raw:
        return 0, 0
    back = raw[::-1]
    letters, first = int(back.translate(_IS_LETTER), 2), int(back.translate(_IS_FIRST), 2)
    return first & ~(letters & (letters << 1)), first


def nth_bit(mask: int, k: int) -> int:
    """The place of the k-th set bit (from 0), by halving."""
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            mask, width = low, half
        else:
            mask, width, k, at = mask >> half, width - half, k - n, at + half
    return at


def infill(raw: bytes, doc_id: int | None, how: Infill) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    starts, first = unit_masks(raw)
    n = starts.bit_count()
    digits = sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k: k + 8], 16) for k in (0, 8, 16, 24))
    marks = how.marks
    if not raw or h3 % 100 >= how.transformed or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    lo, hi = (len(raw) if k == n else nth_bit(starts, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    chars = [(first & ((1 << at) - 1)).bit_count() for at in (lo, hi)]
    (p, s, m), prefix, middle, suffix = marks, raw[:lo], raw[lo:hi], raw[hi:]
    form = "spm" if h4 % 100 < how.suffix_first else "psm"
    out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
    return n, form, chars[0], chars[1] - chars[0], out


def restored(output: bytes, form: str, how: Infill) -> bytes:
    """The text whose output this is: the texts transformed hold no sentinel, so each is found."""
    p, s, m = how.marks
    if form == "plain":
        return output
    one, two = (s, p) if form == "spm" else (p, s)
    head, _, middle = output[len(one):].partition(m)
    first, _, second = head.partition(two)
    return second + middle + first if form == "spm" else first + middle + second


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def fill_in_middle(docs: DataFrame, how: Infill | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row; nothing is shuffled."""
    how = how or Infill()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            rows = [infill(t or b"", d, how) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).view(pa.binary()).to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(output)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(filled: DataFrame, how: Infill | None = None) -> DataFrame:
    """Adds ``restored``, the text rebuilt from the columns ``output`` and ``form`` alone."""
    how = how or Infill()
    at = [filled.columns.index(c) for c in ("output", "form")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, at[0]):
            output, form = batch.column(at[0]).view(pa.binary()).to_pylist(), batch.column(at[1]).to_pylist()
            texts = _strings([restored(o, f, how) for o, f in zip(output, form, strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "restored"])

    return filled.mapInArrow(run, f"{', '.join(f'`{k}` {v}' for k, v in filled.dtypes)}, restored string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS pre, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(u[hi + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN x ELSE pre || mid || suf END) AS restored_sha256 FROM p
"""
