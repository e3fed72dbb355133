"""WARC archives and a two-level capture index.

Writing: each task writes its records as gzip members to one archive in a shared folder and returns
where they lie. Payload digests decide which record is the response of equal payloads and which ones
revisit it. Index: capture keys (reversed host, then path) are range-partitioned and sorted; each task writes
its stretch as a file of compressed blocks, and beside it a directory with each block's keys and byte range. A root
with one row for each such file says which directory to open. Reading: wanted keys are sorted too; a task bisects
the root and a directory, reads the byte ranges of the blocks found, and then those of the records in them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Index lines of a block.
BLOCK_LINES = 3_000
#: Payloads shorter than this are always responses.
LEAST_REVISIT = 0
#: A fixed date for records that come without one: archives are the same whenever they are written.
DATE = "1970-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, by Hadoop's names of schemes too; a bare path is local."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    if uri.startswith("dbfs:/"):  # mounted on every machine of the clusters that have it
        uri = "/dbfs/" + uri[6:].lstrip("/")
    uri = re.sub("^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Reversed host, a closing bracket, then port, path and query; scheme, user, fragment and a leading www. are dropped."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    host, port, rest = m[1].lower().removeprefix("www."), m[2] or "", m[3] or "/"
    return ",".join(reversed(host.split("."))) + ("" if port in ("", ":80", ":443") else port) + ")" + (rest if rest.startswith("/") else "/" + rest)


def record(kind: str, url: str, payload: bytes, digest: str, record_id: str, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    clean = re.sub(r"[\r\n]+", " ", url)
    block = b"" if kind == "revisit" else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    else:
        lines.append("Content-Type: text/html; charset=utf-8")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in lines[1:]))
    n = int(headers["content-length"])
    if not lines[0].startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("broken record")
    return headers, rest[:n]


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        content = z.decompress(data[at:]) + z.flush()
        length = len(data) - at - len(z.unused_data)
        yield at, length, content
        at += length


def record_id(page: object, digest: str) -> str:
    """The same for rows alike in id and payload only."""
    return f"urn:page:{page}:{digest}"


def archive_info(name: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: quillspark\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _digested(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Rows (_id, _url, _html, _sha): the payload's SHA-1 in hex."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.select(F.col(key).alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"), body.alias("_html"), F.sha1(body).alias("_sha"), F.octet_length(body).cast("long").alias("_size"))


_CAPTURES = T.StructType([T.StructField("id", T.LongType()), T.StructField("url_key", T.StringType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for each row of pages; rows (id, url_key, archive, offset, length) say where it lies.

    The smallest id of equal payloads of at least `least` bytes is the response, the others revisit it; a payload that
    occurs once, or a shorter one, is a response. Payloads move once, by id and digest, so equal payloads spread over all
    tasks; the join on digests moves ids only and can be split. Each attempt of a task writes a file of its own, and only rows of the attempt that counts name it.
    """
    rows = _digested(pages, key, url, html)
    firsts = rows.where(F.col("_size") >= least).groupBy("_sha", "_size").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    # Ids of revisits, with the response that they name; only payloads that occur again are among them.
    again = rows.select("_id", "_sha", "_size").join(firsts, ["_sha", "_size"]).where("_id > _first").select("_id", "_sha", "_first").distinct()
    marked = rows.join(again, ["_id", "_sha"], "left")
    return marked.select("_id", "_url", "_html", "_sha", "_first").mapInArrow(_writer(folder), _CAPTURES)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        out = None
        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, sha, first in zip(*(batch.column(n).to_pylist() for n in ("_id", "_url", "_html", "_sha", "_first")), strict=True):
                    if out is None:
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                        info = archive_info(name)
                        out.write(info)
                        at = len(info)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    data = gzip.compress(record("response" if first is None else "revisit", url, html, digest, record_id(page, digest), None if first is None else record_id(first, digest)), 6, mtime=0)
                    out.write(data)
                    rows.append((page, url_key(url), name, at, len(data)))
                    at += len(data)
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=_CAPTURES.names)
        finally:
            if out is not None:
                out.close()

    return run


_READ = T.StructType([T.StructField("id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])
#: Ranges at most so far apart are read together, and at most so many bytes at once.
READ_GAP, READ_MOST = 64 << 10, 8 << 20


def read_ranges(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Read the records at captures' ranges back: (id, payload_bytes, payload_digest, record_type, refers_to, payload).

    Digests of responses are computed anew from the payload that was read and must agree with the header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        for batch in batches:
            wanted: dict[str, list[tuple[int, int]]] = {}
            for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                wanted.setdefault(name, []).append((at, n))
            for name, ranges in wanted.items():
                ranges.sort()
                with system.open_input_file(f"{path}/{name}") as f:
                    i = 0
                    while i < len(ranges):
                        j, begin, end = i, ranges[i][0], sum(ranges[i])
                        while j + 1 < len(ranges) and ranges[j + 1][0] <= end + READ_GAP and sum(ranges[j + 1]) - begin <= READ_MOST:
                            j += 1
                            end = max(end, sum(ranges[j]))
                        data = f.read_at(end - begin, begin)
                        # One batch for each stretch that is read: payloads of no more than that are held.
                        yield _rows([_read(data[at - begin : at - begin + n], with_payload) for at, n in ranges[i : j + 1]], _READ)
                        i = j + 1

    return captures.select("archive", "offset", "length").mapInArrow(run, _READ)


def _read(member: bytes, with_payload: bool) -> tuple:
    headers, block = parse(gzip.decompress(member))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and base32_sha1(block) != digest:
        raise ValueError(f"digest of {headers['warc-record-id']} does not match")
    refers = headers.get("warc-refers-to")
    return _page(headers["warc-record-id"]), int(headers["x-payload-length"]) if kind == "revisit" else len(block), digest, kind, _page(refers) if refers else None, block if with_payload else None


_ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[f.dataType]) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def _page(uri: str) -> int | None:
    text = uri.strip("<>").split(":")[2]
    return None if text == "None" else int(text)


_ROOT = T.StructType([T.StructField("first_key", T.StringType()), T.StructField("last_key", T.StringType()), T.StructField("file", T.StringType()), T.StructField("blocks", T.IntegerType())])
_LINES = T.StructType([T.StructField("url_key", T.StringType()), T.StructField("id", T.LongType()), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])


def build_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Write captures, sorted by key, under path: for each range of keys a file of compressed blocks, and its directory
    (lines of first key, last key, byte offset, byte length), and as path/root rows (first_key, last_key, file, blocks), one for each
    such file. No block holds more than block_lines lines; a key's lines may go on in the next block or file."""
    spark = captures.sparkSession
    ordered = captures.repartitionByRange(common.shuffle_partitions(spark), "url_key", "archive", "offset").sortWithinPartitions("url_key", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(path)
        name, at = uuid.uuid4().hex, 0
        out, held, directory = None, [], []
        try:
            for batch in (*batches, None):
                if batch is not None:
                    held += zip(*(batch.column(n).to_pylist() for n in _LINES.names), strict=True)
                while len(held) >= block_lines or batch is None and held:
                    lines, held = held[:block_lines], held[block_lines:]
                    if out is None:
                        system.create_dir(folder, recursive=True)
                        out = system.open_output_stream(f"{folder}/{name}.blocks", compression=None)
                    block = gzip.compress("".join(json.dumps(x) + "\n" for x in lines).encode(), 6, mtime=0)
                    out.write(block)
                    directory.append((lines[0][0], lines[-1][0], at, len(block)))
                    at += len(block)
        finally:
            if out is not None:
                out.close()
        if directory:
            with system.open_output_stream(f"{folder}/{name}.directory", compression=None) as f:
                f.write("".join(json.dumps(x) + "\n" for x in directory).encode())
            yield _rows([(directory[0][0], directory[-1][1], name, len(directory))], _ROOT)

    ordered.mapInArrow(run, _ROOT).write.parquet(f"{path}/root")


def _overlapping(ranges: list[tuple], lasts: list[str], key: str) -> Iterator[tuple]:
    """Those of sorted ranges (first key, last key, ..) that may hold the key, found by bisection."""
    i = bisect_left(lasts, key)
    while i < len(ranges) and ranges[i][0] <= key:
        yield ranges[i]
        i += 1


class CaptureIndex:
    """Look-ups in an index. The root is held: a row for each task that built the index, however many captures there are."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        self.root = sorted((r["first_key"], r["last_key"], r["file"]) for r in spark.read.schema(_ROOT).parquet(f"{path}/root").collect())

    def blocks_of(self, keys: DataFrame) -> DataFrame:
        """Rows (url_key, file, offset, length): the blocks that may hold each of keys (distinct url_key), by the root and the directories.

        Keys are sorted, so a task opens a directory once and holds one at a time.
        """
        path, root = self.path, self.root
        lasts = [r[1] for r in root]
        schema = "url_key string, file string, offset long, length long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, folder = filesystem(path)
            now, directory, ends = None, [], []
            for batch in batches:
                rows = []
                for key in batch.column("url_key").to_pylist():
                    for _, _, file in _overlapping(root, lasts, key):
                        if file != now:
                            with system.open_input_stream(f"{folder}/{file}.directory", compression=None) as f:
                                directory = [json.loads(x) for x in f.read().decode().splitlines()]
                            now, ends = file, [d[1] for d in directory]
                        rows += [(key, file, at, n) for _, _, at, n in _overlapping(directory, ends, key)]
                columns = zip(*rows, strict=True) if rows else ([],) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["url_key", "file", "offset", "length"])

        parts = common.shuffle_partitions(self.spark)
        return keys.select("url_key").repartitionByRange(parts, "url_key").sortWithinPartitions("url_key").mapInArrow(run, schema)

    def captures(self, keys: DataFrame) -> DataFrame:
        """Captures (url_key, id, archive, offset, length) of keys (distinct url_key); only blocks that may hold one are read.

        Blocks are dealt out evenly, so the captures of one frequent key are not read by one task.
        """
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, folder = filesystem(path)
            name, source, place, keys, lines = None, None, None, set(), []

            def found() -> Iterator[pa.RecordBatch]:
                if rows := [x for x in lines if x[0] in keys]:
                    yield _rows(rows, _LINES)

            try:
                for batch in batches:
                    for key, file, at, n in zip(*(batch.column(c).to_pylist() for c in ("url_key", "file", "offset", "length")), strict=True):
                        if (file, at) != place:
                            yield from found()
                            if file != name:
                                if source is not None:
                                    source.close()
                                name, source = file, system.open_input_file(f"{folder}/{file}.blocks")
                            place, keys = (file, at), set()
                            lines = [tuple(json.loads(x)) for x in gzip.decompress(source.read_at(n, at)).decode().splitlines()]
                        keys.add(key)
                yield from found()
            finally:
                if source is not None:
                    source.close()

        parts = common.shuffle_partitions(self.spark)
        return self.blocks_of(keys).repartition(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, _LINES)

    def lookup(self, urls: list[str]) -> DataFrame:
        """captures() of some URLs."""
        keys = sorted({url_key(u) for u in urls})
        return self.captures(self.spark.createDataFrame([(k,) for k in keys], "url_key string"))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (key, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from archives by looking
    up each different url key in the index.

    Null html is an empty payload, null url an empty one. Rows with equal ids are written each; of equal payloads those
    with the smallest id are responses. A null id is written and read back as null, and never revisits. An empty table
    gives no rows. Other columns are not read. Ids are whole numbers. A very long payload is one record, read alone.
    """
    spark = pages.sparkSession
    scratch = common.Scratch(spark, "warc")
    archives = scratch.path("archives")
    captures = scratch.write(write_archives(pages, archives, key, url, html), "captures")
    index = scratch.path("index")
    build_index(captures, index)
    found = CaptureIndex(spark, index).captures(captures.select("url_key").distinct())
    read = read_ranges(_by_archive(found), archives)
    return read.select(F.col("id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _by_archive(captures: DataFrame) -> DataFrame:
    """Captures dealt by stretches of archives, so that neighbouring ranges are read together and no archive weighs on one task."""
    stretch: Column = F.floor(F.col("offset") / READ_MOST)
    return captures.repartition(common.shuffle_partitions(captures.sparkSession), "archive", stretch).sortWithinPartitions("archive", "offset")
