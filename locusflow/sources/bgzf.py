"""A VCF compressed in blocks (bgzip), read by several tasks.

The file is cut into byte ranges.  A task begins at the first block border in its range,
leaves out what comes before the first line end (the task before reads that line to its
end), and stops behind the line that its last block leaves open.  The header and the
first row are read once, on the driver, for the names of sample and fields; chromosome
and position bounds are given to the tasks, which look at them before anything else of a line.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Fixed values of the format: a block's first bytes and its empty last block, and a VCF's columns.
MAGIC = b"\x1f\x8b\x08\x04"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
_BLOCK = 1 << 16


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def block_size(head: bytes) -> int | None:
    """The length of the block that begins with these bytes, or None if none does."""
    if len(head) < 18 or not head.startswith(MAGIC):
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(len(head), 12 + extra):
        tag, n = head[at: at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if tag == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def files_of(path: str):
    """(file system, files): the file itself, or of a folder all compressed files by name."""
    from pyarrow import fs

    system, name = file_system(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return system, [name]
    return system, sorted(x.path for x in system.get_file_info(fs.FileSelector(name)) if x.path.lower().endswith((".gz", ".bgz")))


def is_bgzf(path: str) -> bool:
    try:
        system, names = files_of(path)
        with system.open_input_file(names[0]) as f:
            return block_size(f.read(64)) is not None
    except (OSError, IndexError):
        return False


def packed(data: bytes) -> bytes:
    """Bytes as one block; at most 65,280 of them."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bgzf(lines: Iterator[bytes], path: str, size: int = 60_000) -> None:
    system, name = file_system(path)
    system.create_dir(name.rpartition("/")[0] or ".")
    with system.open_output_stream(name, compression=None) as out:
        held = b""
        for line in lines:
            held += line
            while len(held) >= size:
                out.write(packed(held[:size]))
                held = held[size:]
        out.write(packed(held) + LAST_BLOCK)


def first_block(f, start: int, end: int) -> int | None:
    """Where the first block in [start, end) begins: a header whose length leads to another
    header, or to the file's end."""
    at = start
    while at < end:
        window = f.read_at(2 * _BLOCK, at)
        k = window.find(MAGIC)
        while 0 <= k < len(window) and at + k < end:
            head = f.read_at(64, at + k)
            n = block_size(head)
            if n is not None:
                after = f.read_at(64, at + k + n)
                if not after or block_size(after) is not None:
                    return at + k
            k = window.find(MAGIC, k + 1)
        if len(window) < 2 * _BLOCK:
            return None
        at += len(window) - 3
    return None


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks from ``at`` on."""
    size = f.size()
    while at < size:
        head = f.read_at(64, at)
        n = block_size(head)
        if n is None:
            raise ValueError(f"no block at byte {at}")
        raw = f.read_at(n, at)
        content = zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0]: -8], -15)
        if zlib.crc32(content) != struct.unpack_from("<I", raw, n - 8)[0]:
            raise ValueError(f"the block at byte {at} is damaged")
        yield at, content
        at += n


def lines_of(f, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin behind the first line end in the range (in the file, for its first)."""
    at = first_block(f, start, end)
    if at is None:
        return
    skipping, open_line = start > 0, b""
    for place, content in blocks(f, at):
        if place >= end:
            head, ended, _ = content.partition(b"\n")
            if skipping:
                return
            open_line += head
            if ended:
                yield open_line
                return
            continue
        if skipping:
            _, ended, content = content.partition(b"\n")
            if not ended:
                continue
            skipping = False
        *whole, rest = (open_line + content).split(b"\n")
        yield from whole
        open_line = rest
    if open_line:
        yield open_line


def header(path: str) -> tuple[list[str], list[str]]:
    """(samples, FORMAT keys) of the (first) file: declared keys, and those of the first row."""
    system, names = files_of(path)
    samples, keys = None, []
    with system.open_input_file(names[0]) as f:
        for raw in lines_of(f, 0, f.size()):
            line = raw.decode()
            if line.startswith("##FORMAT=<ID="):
                keys.append(line[len("##FORMAT=<ID="):].split(",")[0])
            elif line.startswith("#CHROM"):
                names = line.split("\t")
                samples = names[names.index("FORMAT") + 1:] if "FORMAT" in names else []
            elif not line.startswith("#"):
                keys += [k for k in line.split("\t")[8].split(":") if k not in keys] if samples else []
                break
    if samples is None:
        raise ValueError("no #CHROM header")
    return samples, keys


class _Range(InputPartition):
    def __init__(self, names: list[str], start: int, end: int):
        self.names, self.start, self.end = names, start, end


class VcfReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.options = dict(options)
        self.names = schema.fieldNames()

    def partitions(self):
        system, names = files_of(self.options["path"])
        if int(self.options.get("rows", -1)) >= 0:
            return [_Range(names, 0, 1 << 62)]
        step = int(self.options.get("split", 32 << 20))
        sizes = {name: system.get_file_info(name).size for name in names}
        return [_Range([name], a, min(size, a + step)) for name, size in sizes.items() for a in range(0, size, step)] or [_Range(names[:1], 0, 0)]

    def read(self, partition: _Range):
        o, left = self.options, int(self.options.get("rows", -1))
        keys = self.names[9:]
        chrom, low, high = o.get("chromosome"), int(o.get("low", -1)), int(o.get("high", 1 << 62))
        layouts: dict[str, list[int]] = {}
        system, _ = file_system(o["path"])
        rows: list[tuple] = []
        for name in partition.names:
            with system.open_input_file(name) as f:
                for raw in lines_of(f, partition.start, partition.end):
                    if not raw or raw.startswith(b"#"):
                        continue
                    if left == 0:
                        break
                    left -= 1
                    c, pos, rest = raw.decode().rstrip("\r").split("\t", 2)
                    c = c.replace("chr", "")
                    if (chrom is not None and c != chrom) or not (pos.isdigit() and low <= int(pos) < high):
                        continue
                    fields = rest.split("\t")
                    layout = layouts.get(fields[6])
                    if layout is None:
                        layout = layouts[fields[6]] = self._layout(fields[6], keys)
                    values = fields[7].split(":")
                    rows.append((int(c) if c.isdigit() else None, int(pos), *fields[:6], fields[6], *(_number(values[k]) if 0 <= k < len(values) else None for k in layout)))
                    if len(rows) == 8192:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _layout(form: str, keys: list[str]) -> list[int]:
        mine = form.split(":")
        if odd := [k for k in mine if k not in keys]:
            raise ValueError(f"FORMAT {form} has keys {odd} that neither the header nor the first row names")
        if lacks := [k for k in ("ES", "SE", "LP") if k not in mine]:
            raise ValueError(f"FORMAT {form} lacks {lacks}")
        return [mine.index(k) if k in mine else -1 for k in keys]

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 7, *[pa.float64()] * (len(self.names) - 9)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=self.names)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


class VcfDataSource(DataSource):
    """``bgzf_vcf``: options path, split (bytes), chromosome, low, high, rows."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_vcf"

    def schema(self) -> str:
        keys = self.options["keys"].split(",")
        return ", ".join(["CHR long", "POS long", *[f"{c} string" for c in COLUMNS[2:]], *[f"{k} double" for k in keys]])

    def reader(self, schema: StructType) -> VcfReader:
        return VcfReader(schema, self.options)


def read_bgzf_vcf(spark: SparkSession, path: str, allowed: tuple[str, ...], num_rows: int | None = None, chromosome: int | None = None, low: int | None = None, high: int | None = None, split: int = 32 << 20) -> DataFrame:
    """The rows of a block-compressed VCF with one column per FORMAT key, numbers parsed.
    ``chromosome`` and positions low <= POS < high are looked at before a line is split."""
    samples, keys = header(path)
    if len(samples) != 1:
        raise ValueError("exactly one sample column is needed behind FORMAT")
    if odd := [k for k in keys if k not in allowed]:
        raise ValueError(f"unknown FORMAT keys {odd}")
    spark.dataSource.register(VcfDataSource)
    options = {"path": path, "keys": ",".join(k for k in allowed if k in keys), "split": split, "rows": -1 if num_rows is None else num_rows}
    options |= {k: str(v) for k, v in (("chromosome", chromosome), ("low", low), ("high", high)) if v is not None}
    return spark.read.format("bgzf_vcf").options(**options).load()
