"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing: a record is one row of text, "headers, blank line, block", and Spark's line
separator is the CRLF CRLF that ends a WARC record, so archives come from Spark's own
committed writer and reach any file system it knows.  Payloads seen before (equal
bytes) become ``revisit`` records that refer to the one that is kept.

Reading: ``spark.read.format("warc")``.  Files are planned into partitions by size.
Filters on the record type and on header columns are pushed down; the reader parses
headers first and skips the block of a record they reject, or of every record if the
schema asked for has no ``payload``.

Defined results: a null payload is empty; equal payloads in repeated rows with one id
are all responses; a null id has no refers_to target and counts as the smallest; line
breaks in a url are percent-encoded; an empty table writes an archive without records;
other columns are never read.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .common import Scratch, n_partitions, table

# Fixed values of the WARC and base32 formats.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Rows of the table that tells repeated payloads, at most.
SLOTS = 1 << 19
#: Bytes of payload an archive holds at least, once there are many.
ARCHIVE_BYTES = 256 << 20

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, file string, position long, payload binary"
#: Columns that are headers of a record, and those headers.
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_PUSHED = {c: h for c, h in _HEADERS.items() if c != "payload_digest"}


def base32(sha: Column) -> Column:
    """A SHA-1 in hex as bare upper-case base32: each 20 bits (5 hex digits) are 4 letters."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substr(sha, g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, by: F.substr(F.lit(_BASE32), F.shiftright(v, by).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(*[letter(v, by) for by in (15, 10, 5, 0)])), "")


def page_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, bytes, digest, record_type, refers_to): of equal payloads of
    ``min_bytes`` or more the one with the largest id is a response, the others revisit it."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    repeated = rows.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = Scratch(pages.sparkSession).save(repeated)
    # payloads that surely come once need no join: at most SLOTS rows are broadcast to tell them
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = F.broadcast(repeated.select(slot("sha").alias("slot")).distinct())
    single = rows.join(slots, slot(rows["sha"]) == slots["slot"], "left_anti").withColumn("kept", F.lit(None).cast("long"))
    several = rows.join(slots, slot(rows["sha"]) == slots["slot"], "left_semi").join(repeated, ["sha", "bytes"], "left").select("id", "url", "payload", "bytes", "sha", "kept")
    again = (F.col("kept") != F.coalesce("id", F.lit(-(1 << 62))))
    return single.unionByName(several).select(
        "id", "url", "payload", "bytes", base32(F.col("sha")).alias("digest"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("kept")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, total_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Archives of ``page_records`` rows below ``path``, one per partition; partitions too
    many for ``total_bytes`` of payload are put together (each file holds native buffers)."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(F.lit(_HTTP), F.col("payload"))).otherwise(F.lit(_HTTP))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(~response, F.lit(f"WARC-Profile: {_REVISIT}")), F.when(~response, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    most = max(n_partitions(records.sparkSession), total_bytes // ARCHIVE_BYTES)
    records.select(F.concat(head, F.lit(_END), block).alias("value")).coalesce(most).write.option("lineSep", _END).option("compression", compression).text(path)


class FilesPartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _file_system(path: str):
    from pyarrow import fs

    path = re.sub(r"^(\w+):/(?!/)", r"\1:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_records(stream: io.BufferedIOBase, wanted, with_block) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(position, headers, block) of the records whose headers ``wanted`` accepts; the
    block is skipped, not decoded, unless ``with_block`` asks for it."""
    at = 0
    while line := stream.readline():
        begin, at = at, at + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record at {begin}: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            at += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        at += len(line)
        left = int(headers.get("content-length", 0))
        at += left
        if wanted(headers) and with_block:
            yield begin, headers, stream.read(left)
            continue
        if wanted(headers):
            yield begin, headers, None
        while left:
            left -= len(skipped := stream.read(min(left, 1 << 20)))
            if not skipped:
                return


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.schema = schema.names, schema
        self.path = options["path"]
        self.bytes = int(options.get("partition_bytes", 8 << 20))
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in _PUSHED:
                self.tests.append((_HEADERS[column], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = _file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        groups, size = [[]], 0
        for x in sorted((x for x in found if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            if groups[-1] and size + x.size > self.bytes:
                groups.append([])
                size = 0
            groups[-1].append(prefix + x.path)
            size += x.size
        return [FilesPartition(g) for g in groups if g]

    def read(self, partition: FilesPartition):
        wanted = lambda h: all(h.get(k) in values for k, values in self.tests)
        rows, size = [], 0
        for name in partition.files if partition else ():
            system, path = _file_system(name)
            with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
                for position, headers, block in read_records(io.BufferedReader(stream) if name.endswith(".gz") else io.BufferedReader(_Raw(stream)), wanted, "payload" in self.columns):
                    rows.append(self._row(name, position, headers, block))
                    size += len(block or b"") + 500
                    if size > 4 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, name: str, position: int, headers: dict[str, str], block: bytes | None) -> dict:
        payload = block
        if block is not None and headers.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        length = headers.get("x-payload-length")
        row = {c: headers.get(h) for c, h in _HEADERS.items()}
        row["payload_length"] = int(length) if length else None
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].partition(":")[2]
        return row | {"headers": headers, "file": name, "position": position, "payload": payload if headers.get("warc-type") != "revisit" else None}

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_length": pa.int64(), "position": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        pick = lambda c: [list(r[c].items()) for r in rows] if c == "headers" else [r[c] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(pick(c), kinds.get(c, pa.string())) for c in self.columns], names=self.columns)


class _Raw(io.RawIOBase):
    """A pyarrow stream as a raw Python stream."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.stream.read(len(into))
        into[: len(data)] = data
        return len(data)


class WarcDataSource(DataSource):
    """Options: path; partition_bytes (files of a partition together, 8 MB).  The
    digest column is bare (no ``sha1:``), so filters on it are not pushed down."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").schema(columns).load(path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("warc")
    pages = table(spark, sf_dir, "pages")
    write_warc(page_records(pages), path, pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0)
    page = lambda c: F.regexp_extract(c, "urn:page:(-?[0-9]+)", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    read = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    # a response's digest is that of the payload that was read, a revisit's the one it names
    digest = F.when(F.col("payload").isNotNull(), base32(F.sha1("payload"))).otherwise(F.col("payload_digest"))
    return read.select(
        number("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS kept FROM p GROUP BY h),
b AS (SELECT page_id, strlen(p.h)::BIGINT AS n, kept, ('0x' || sha1(p.h)) AS x, sha1(p.h) AS s FROM p JOIN g USING (h)),
d AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, i * 5 + 1, 5))::BIGINT >> k) & 31) + 1)::BIGINT, 1)), '')), '') AS dig FROM b)
SELECT page_id, n AS payload_bytes, dig AS payload_digest, CASE WHEN kept IS NULL OR page_id IS NOT DISTINCT FROM kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM d
"""
