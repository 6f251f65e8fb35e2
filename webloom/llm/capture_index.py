"""Two-level capture index over WARC archives.

``archive`` writes pages as WARC response records, each its own gzip member, to one file a task, and
gives their captures: reversed-host URL key, file, offset, length. ``build`` sorts the captures by key
over the cluster into parts of about PART_LINES lines. A part is one file: compressed blocks of
BLOCK_LINES lines, then its sparse directory, that is first and last key, offset and length of each block. The
parts, one row each, are a table. ``lookup`` takes the distinct keys asked for to the parts that may hold
them, sorts them there, and walks: binary search of the part's directory, range read of a block, binary search of
its lines, range read of each captured record.

A worker holds one part's directory, one block and one record. A key of very many captures spans parts,
and is looked up in each of them by another task; each capture is found once, however many ask for its key.
Page bodies never shuffle. Files go to the shared folder under names no other attempt has; the
captures and the parts are written as tables, so that only what finished tasks wrote is ever
looked up, whatever executors are lost.

Defined cases: a null URL is not archived and finds nothing; an empty URL has the key ")"; a null body
is archived as an empty one; white space and control signs of a URL are percent-encoded in its record;
several captures of a key are all found; equal keys may span blocks and
parts; repeated rows are captures of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import named, shared_dir, small_batches, stored

BLOCK_LINES = 1000
#: Captures to a part of the index.
PART_LINES = 200_000
#: Rows to a batch of the result.
FOUND_ROWS = 2000
#: Time of capture, where the pages have none.
CAPTURED = "2000-01-01T00:00:00Z"
CAPTURE = "urlkey string, page_id long, file string, offset long, length long"
PARTS = "part int, first_key string, last_key string, file string, offset long, length long, blocks int, lines long"
FOUND = "urlkey string, capture_id long, body_bytes long, body_md5 string, asked long"


def url_key(url: Column) -> Column:
    """example.com/a?b -> com,example)/a?b ; scheme, user, port and fragment go."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    path = F.substr(rest, F.length(host) + 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", ""))
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), F.lit(")"), path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder of the shared storage, which shared_dir names with its scheme."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends blobs to one new file."""

    def __init__(self, folder: str, suffix: str):
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.out = self.fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.at = 0

    def append(self, blob: bytes) -> tuple[int, int]:
        """(offset, length)."""
        self.out.write(blob)
        self.at += len(blob)
        return self.at - len(blob), len(blob)


class Reader:
    """Range reads of the files of a folder, of which the last few stay open."""

    def __init__(self, folder: str, most: int = 64):
        self.fs, self.path = filesystem(folder)
        self.open: dict[str, object] = {}
        self.most = most

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.pop(name, None) or self.fs.open_input_file(f"{self.path}/{name}")
        self.open[name] = f
        if len(self.open) > self.most:
            self.open.pop(next(iter(self.open))).close()
        return f.read_at(length, offset)


_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record(url: str, page_id: int | None, body: bytes, date: str = CAPTURED) -> bytes:
    """A WARC response record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    ident = uuid.UUID(bytes=hashlib.md5(f"{page_id} {url}".encode()).digest())
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url.strip())
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\nWARC-Record-ID: <urn:uuid:{ident}>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(body)}\r\n\r\n".encode()
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(head + http + body + b"\r\n\r\n") + c.flush()


def _block(raw: bytes) -> bytes:
    """What follows the headers, as long as their Content-Length says."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]) if k.lower() == b"content-length")
    return rest[:length]


def body_of(member: bytes) -> bytes:
    """The HTTP body of a record."""
    return _block(_block(zlib.decompress(member, 31)))


def archive(pages: DataFrame, folder: str, date: str = CAPTURED) -> DataFrame:
    """Write the pages; their captures as CAPTURE."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            writer = writer or Writer(folder, ".warc.gz")
            keys, ids, urls, bodies = (batch.column(c) for c in ("urlkey", "page_id", "url", "html"))
            places = [writer.append(record(u.as_py(), i.as_py(), (b.as_py() or "").encode(), date)) for i, u, b in zip(ids, urls, bodies)]
            n = len(places)
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array([writer.name] * n, pa.string()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())], names=["urlkey", "page_id", "file", "offset", "length"])
        if writer:
            writer.out.close()  # before the task ends, so before its rows count

    rows = pages.select(url_key(named(pages, "url")).alias("urlkey"), named(pages, "page_id").cast("long").alias("page_id"), named(pages, "url").alias("url"), named(pages, "html").alias("html")).filter("urlkey is not null")
    return stored(rows.mapInArrow(run, CAPTURE), "captures")


def escaped(key: Column) -> Column:
    """A key in a line of a block: no tab, no line end."""
    for c, e in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
        key = F.replace(key, F.lit(c), F.lit(e))
    return key


def unescaped(key: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), key)


def build(captures: DataFrame, folder: str, *, block_lines: int = BLOCK_LINES, part_lines: int = PART_LINES) -> DataFrame:
    """Write the sorted parts; their table as PARTS. Lines sort by escaped key."""
    spark = captures.sparkSession
    parts = max(1, -(-captures.count() // part_lines), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64))
    ordered = captures.withColumn("urlkey", escaped(F.col("urlkey"))).repartitionByRange(parts, "urlkey", "page_id", "file", "offset").sortWithinPartitions("urlkey", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, lines, first, last, directory, n = None, [], "", "", [], 0

        def flush() -> None:
            at, size = writer.append(zlib.compress("\n".join(lines).encode(), 6))
            directory.append((first, last, at, size))
            lines.clear()

        for batch in batches:
            writer = writer or Writer(folder, ".idx")
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                first = first if lines else row[0]
                last = row[0]
                lines.append("\t".join(map(str, row)))
                n += 1
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if writer:
            at, size = writer.append(zlib.compress("\n".join("\t".join(map(str, d)) for d in directory).encode(), 6))
            writer.out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "first_key": directory[0][0], "last_key": directory[-1][1], "file": writer.name, "offset": at, "length": size, "blocks": len(directory), "lines": n}], schema=pa.schema([("part", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("blocks", pa.int32()), ("lines", pa.int64())]))

    return stored(ordered.mapInArrow(run, PARTS), "capture-parts")


class Part:
    """A part's directory, and the block that was read last."""

    def __init__(self, reader: Reader, file: str, offset: int, length: int):
        self.reader, self.file = reader, file
        entries = [x.split("\t") for x in zlib.decompress(reader.read(file, offset, length)).decode().split("\n")]
        self.firsts, self.lasts = ([e[i].encode() for e in entries] for i in (0, 1))
        self.places = [(int(e[2]), int(e[3])) for e in entries]
        self.held: tuple[int, list, list] = (-1, [], [])

    def lines(self, key: bytes) -> Iterator[list[str]]:
        """The lines of a key, as lists of cells."""
        i = bisect.bisect_left(self.lasts, key)
        while i < len(self.lasts) and self.firsts[i] <= key:
            if self.held[0] != i:
                cells = [x.split("\t") for x in zlib.decompress(self.reader.read(self.file, *self.places[i])).decode().split("\n")]
                self.held = (i, cells, [x[0].encode() for x in cells])
            _, cells, keys = self.held
            j = bisect.bisect_left(keys, key)
            while j < len(keys) and keys[j] == key:
                yield cells[j]
                j += 1
            i += 1


def lookup(queries: DataFrame, parts: DataFrame, index_folder: str, archive_folder: str) -> DataFrame:
    """FOUND, a row for each capture of each key that a row of queries (url) has; asked: how many have it.
    The driver and the workers hold one entry a part."""
    spark = queries.sparkSession
    bounds = sorted((r.last_key.encode(), r.first_key.encode(), r.part, r.file, r.offset, r.length) for r in parts.collect())
    held = spark.sparkContext.broadcast(bounds)

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lasts = [b[0] for b in held.value]
        for keys in batches:
            out = []
            for k in keys.to_pylist():
                k = k.encode()
                i, own = bisect.bisect_left(lasts, k), []
                while i < len(lasts) and held.value[i][1] <= k:
                    own.append(i)
                    i += 1
                out.append(own)
            yield pa.array(out, pa.list_(pa.int32()))

    asked = queries.select(escaped(url_key(named(queries, "url"))).alias("urlkey")).filter("urlkey is not null").groupBy("urlkey").agg(F.count("*").alias("asked"))
    asked = asked.withColumn("part", F.explode(F.arrow_udf(place, "array<int>")("urlkey"))).repartition("part").sortWithinPartitions("part", "urlkey")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, records = Reader(index_folder), Reader(archive_folder)
        at, part, out = None, None, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["urlkey", "capture_id", "body_bytes", "body_md5", "asked"])

        for rows in batches:
            for key, n, i in zip(*(rows.column(c).to_pylist() for c in ("urlkey", "asked", "part"))):
                if i != at:
                    at, part = i, Part(index, *held.value[i][3:])
                for _, capture, file, offset, length in part.lines(key.encode()):
                    body = body_of(records.read(file, int(offset), int(length)))
                    out.append((unescaped(key), int(capture) if capture != "None" else None, len(body), hashlib.md5(body).hexdigest(), n))
                    if len(out) >= FOUND_ROWS:
                        yield batch()
        yield batch()

    return asked.mapInArrow(search, FOUND)


def indexed(pages: DataFrame) -> DataFrame:
    """Archive and index all pages, then look every page's URL up."""
    spark = pages.sparkSession
    records, index = shared_dir(spark, "warc"), shared_dir(spark, "capture-index")
    parts = build(archive(pages, records), index)
    return lookup(pages, parts, index, records)


def oracle() -> str:
    return r"""
WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM pages WHERE url IS NOT NULL),
b AS (SELECT *, regexp_extract(r, '^([^/?]*)', 1) AS h FROM a),
c AS (SELECT page_id, coalesce(html, '') AS html, array_to_string(list_reverse(string_split(lower(regexp_replace(regexp_replace(h, '^.*@', ''), ':\d*$', '')), '.')), ',') || ')' || substr(r, length(h) + 1) AS urlkey FROM b)
SELECT urlkey, page_id AS capture_id, CAST(strlen(html) AS BIGINT) AS body_bytes, md5(html) AS body_md5, count(*) OVER (PARTITION BY urlkey) AS asked
FROM c"""
