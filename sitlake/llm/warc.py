"""WARC archives with a two-level capture index.

Pages are written as records, one gzip member each; equal payloads are kept once and revisited.  The
index sorts reversed-host keys into compressed blocks; each index file ends in a sparse directory of its
blocks, and a list of the files' key ranges tops it.  A look-up searches the list, then the directory,
reads one block and then the record's own range.  Index files are ranges of (key, page), so a host or a
URL with many captures spans files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import range_count, scratch_dir, shared_fs, ship, stored, utf8, with_small


@dataclass(frozen=True)
class WarcRules:
    #: Bytes of a payload from which equal ones are revisited.
    least: int = 1000
    #: WARC-Date of all records: the pages carry no time.
    date: str = "1970-01-01T00:00:00Z"
    #: Lines of an index block, and about so many of an index file at most.
    block: int = 500
    file_lines: int = 262_144
    level: int = 5


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: scheme and fragment go, the host's labels turn round, odd characters are quoted."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", (url or "").strip()).split("#", 1)[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    name, _, port = host.rpartition("@")[2].lower().partition(":")
    turned = ",".join(reversed([x for x in name.split(".") if x])) + (f":{port}" if port not in ("", "80", "443") else "")
    return quote(f"{turned}){slash or '/'}{path}", safe="!$&'()*+,-./:;=?@_~%", encoding="utf-8", errors="surrogatepass")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sort key of a capture: the URL's key, then the page."""
    return f"{surt(url)} {'' if page_id is None else format(page_id + (1 << 63), '020d')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, rules: WarcRules) -> bytes:
    """A record: response with the payload, or revisit with its HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {rules.date}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=_URI)}"]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "".join(chr(c) for c in range(33, 127))


def parse_record(data: bytes) -> dict:
    """Page, payload size and digest, type and reference from a record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()

    def page(name: str) -> int | None:
        text = fields.get(name, "<urn:page:>")[len("<urn:page:") : -1]
        return int(text) if text else None

    revisit = fields["WARC-Type"] == "revisit"
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = stated if revisit else hashlib.sha1(payload).hexdigest()
    if digest != stated or (not revisit and size != len(payload)):
        raise ValueError("a record's payload differs from its header")
    return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To")}


def _gzip(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _archiver(folder: str, rules: WarcRules):
    def run(batches):
        from pyspark import TaskContext

        fs, root = shared_fs(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        at = 0
        with fs.open_output_stream(path, compression=None) as out:
            for batch in batches:
                keys, offsets, lengths = [], [], []
                for page_id, url, html, digest, revisit, refers_to in zip(*batch.columns, strict=True):
                    page_id, url = page_id.as_py(), url.as_py()
                    data = _gzip(record(page_id, url, utf8(html.as_py()), digest.as_py(), refers_to.as_py(), revisit.as_py(), rules), rules.level)
                    out.write(data)
                    keys.append(capture_key(url, page_id))
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([path] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "file", "at", "n"])

    return run


def _indexer(folder: str, rules: WarcRules):
    """One index file from a sorted range of captures; returns its row of the top list."""

    def run(batches):
        from pyspark import TaskContext

        fs, root = shared_fs(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.idx"
        directory, lines, at, last = [], [], 0, None
        with fs.open_output_stream(path, compression=None) as out:

            def flush():
                nonlocal at, lines
                data = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
                out.write(data)
                directory.append([lines[0][0], at, len(data), len(lines)])
                at += len(data)
                lines = []

            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    lines.append(row)
                    last = row[0]
                    if len(lines) == rules.block:
                        flush()
            if lines:
                flush()
            out.write(zlib.compress(json.dumps(directory).encode(), 6))
            size = out.tell() - at
        if directory:
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([last]), pa.array([path]), pa.array([at], pa.int64()), pa.array([size], pa.int64())], names=["first", "last", "path", "at", "n"])
        else:
            fs.delete_file(path)

    return run


class _Recent(OrderedDict):
    """The values made last, at most ``most``; close() is called on what leaves, where there is one."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make = most, make

    def of(self, key):
        if key in self:
            self.move_to_end(key)
        else:
            self[key] = self.make(*key)
            if len(self) > self.most:
                left = self.popitem(last=False)[1]
                if hasattr(left, "close"):
                    left.close()
        return self[key]


class Lookup:
    """Captures by key from the top list of index files, each (first, last, path, at, n)."""

    def __init__(self, folder: str, top: list[tuple], gap: int = 1 << 16, span: int = 8 << 20):
        """gap: bytes between two records that are read rather than skipped; span: bytes of one read at most, unless a record is longer."""
        fs, _ = shared_fs(folder)
        self.gap, self.span = gap, span
        self.top, self.lasts = top, [x[1] for x in top]
        self.files = _Recent(16, lambda path: fs.open_input_file(path))
        self.directories = _Recent(4, lambda path, at, n: json.loads(zlib.decompress(self.range(path, at, n))))
        self.blocks = _Recent(8, lambda path, at, n: [x.split("\t") for x in zlib.decompress(self.range(path, at, n)).decode().split("\n")])

    def range(self, path: str, at: int, n: int) -> bytes:
        file = self.files.of((path,))
        file.seek(at)
        return file.read(n)

    def lines(self, key: str):
        """Index lines of a key; blocks are searched, not scanned."""
        k = bisect_left(self.lasts, key)
        if k == len(self.top) or self.top[k][0] > key:
            return
        _, _, path, at, n = self.top[k]
        directory = self.directories.of((path, at, n))
        b = max(bisect_left(directory, key, key=lambda x: x[0]) - 1, 0)
        while b < len(directory) and directory[b][0] <= key:
            block = self.blocks.of((path, directory[b][1], directory[b][2]))
            i = bisect_left(block, key, key=lambda x: x[0])
            yield from block[i : bisect_right(block, key, key=lambda x: x[0])]
            b += 1

    def records(self, keys: list[str]):
        """Records of sorted keys; look-ups that lie near each other in a file are read as one range."""
        wanted = sorted({(path, int(at), int(n)) for key in keys for _, path, at, n in self.lines(key)})
        first = 0
        for k in range(1, len(wanted) + 1):
            path, start, _ = wanted[first]
            if k < len(wanted) and wanted[k][0] == path and wanted[k][1] - sum(wanted[k - 1][1:]) <= self.gap and sum(wanted[k][1:]) - start <= self.span:
                continue
            data = self.range(path, start, sum(wanted[k - 1][1:]) - start)
            for _, at, n in wanted[first:k]:
                yield parse_record(zlib.decompress(data[at - start : at - start + n], 31))
            first = k


def _found(folder: str, top, schema: pa.Schema):
    def run(batches):
        lookup = Lookup(folder, top.value)
        for batch in batches:
            rows = list(lookup.records(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(list(map(capture_key, batch.column(0).to_pylist(), batch.column(1).to_pylist())), pa.string())], names=["key"])


@dataclass(frozen=True)
class Archive:
    folder: str
    #: One row per index file: (first, last, path, at, n).
    top: DataFrame


def write_warc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules: WarcRules = WarcRules(), folder: str | None = None) -> Archive:
    """Write one record per row, and the index.

    Null html is an empty payload; null URLs share the key of an empty one.  Of equal payloads of at least
    ``least`` bytes the row with the largest page id is the response (all rows with that id, if it repeats;
    null ids are below all others), the rest revisit it.  A page of any length is one record.  An empty table
    gives no file; other columns of pages, whatever their names, have no effect.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_dir(spark, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    large = rows.filter(F.octet_length("html") >= rules.least)
    firsts = large.groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND keep IS NOT NULL")
    firsts = stored(firsts.select(F.col("digest").alias("of"), "keep"), "payloads")
    rows = with_small(rows, firsts, F.col("digest") == F.col("of"), row_bytes=80)
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull(), F.lit(False))
    rows = rows.select("id", "url", "html", "digest", revisit.alias("revisit"), "keep")
    captures = stored(rows.mapInArrow(_archiver(folder, rules), "key string, file string, at long, n long"), "captures")
    files = range_count(spark, captures.count(), rules.file_lines, 8 * rules.block)
    ranged = captures.repartitionByRange(files, "key").sortWithinPartitions("key", "file", "at")
    top = stored(ranged.mapInArrow(_indexer(folder, rules), "first string, last string, path string, at long, n long"), "top")
    return Archive(folder, top)


def read_warc(spark: SparkSession, archive: Archive, wanted: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Captures of the wanted (url, page) rows: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Look-ups are sorted by key and dealt out by ranges, so neighbours share blocks.  A page that was
    written several times under a URL gives all its records once.
    """
    ship(spark)
    top = sorted(tuple(r) for r in archive.top.collect())  # one row per index file
    shared = spark.sparkContext.broadcast(top)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    keys = stored(wanted.select(F.col(url).alias("url"), F.col(page_id).cast("long").alias("id")).mapInArrow(_keys, "key string").distinct(), "keys")
    keys = keys.repartitionByRange(max(1, len(top)), "key").sortWithinPartitions("key")
    return keys.mapInArrow(_found(archive.folder, shared, schema), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
