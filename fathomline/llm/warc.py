"""WARC records in ZIP-packaged archives, written and read by ranges.

Writing. Tasks of about ``ARCHIVE_BYTES`` of payload (more and smaller ones where cores would be idle) stream their
pages into archives of at most ``ARCHIVE_BYTES``: a stored member
``archive/data.warc.gz`` with a gzip member for each record, and a stored member
``indexes/index.cdxj`` with a line for each record (key, offset, length). Of pages with equal
payloads of ``MIN_REVISIT`` bytes or more, the one with the smallest id is a response and the
others are revisits of it; smaller payloads are all responses. An archive counts only when its task
ends well: the manifest, written through Spark's commit protocol, names it.

Reading. The manifest's archives are opened by their central (or ZIP64) directory; all indexes are
range-read (24 bytes a record are held for one archive), their lines, with or without a key and a
time, give the member by its file name, and records that no index names are an error. The records
are cut into spans of about ``SPAN_BYTES``, the spans are dealt to one task for each ``TASK_BYTES`` of archives, and each is
one range read whose records are unpacked one by one. Nothing is extracted to disk. Lengths and
digests are verified against the headers, and the number of records against the manifest.

Files go through ``pyarrow.fs``, so the folder may be on any store that pyarrow opens.

Defined cases: a null payload is empty; null ids rank last and are named by null; pages that share
the smallest id of their payload are all responses; a null URL leaves the header out; an empty
table gives no archives and no records. A page's other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import uuid
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import zipdir
from .workspace import Workspace

MIN_REVISIT = 100
ARCHIVE_BYTES, TASK_BYTES, SPAN_BYTES = 128 << 20, 64 << 20, 4 << 20
#: archives whose directories one task reads
TASK_ARCHIVES = 16
RECORD_DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    tail = name.removeprefix("<urn:page:").removesuffix(">")
    return None if tail == "null" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header of its page and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.split(b":", 1) for x in lines if x)
    return {k.strip().decode().lower(): v.strip().decode() for k, v in pairs}


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; raises where a length does not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise zipdir.BadArchive("a record has no WARC version")
    warc = _headers(lines[1:])
    n = int(warc["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise zipdir.BadArchive(f"{warc.get('warc-record-id')} is cut")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return warc, _headers(http.split(b"\r\n")[1:]), payload


class _Archive:
    """An archive that is being written."""

    def __init__(self, store: fs.FileSystem, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.stream = store.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(_Sink(self.stream), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, name: str, raw: bytes) -> None:
        packed = gzip.compress(raw, compresslevel=5, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"id": name, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as out:
            for line in self.index:
                out.write(line.encode() + b"\n")
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index)


class _Sink:
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _tasks(spark: SparkSession, size: int, each: int, least: int) -> int:
    """One task for each ``each`` of the size, more while cores are idle and a task has ``least``."""
    return max(1, math.ceil(size / each), min(spark.sparkContext.defaultParallelism, math.ceil(size / least)))


def _writer(root: str):
    def run(batches):
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        now, done = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, size, digest, refers = (batch.column(c)[k].as_py() for c in range(6))
                if now is None:
                    now = _Archive(store, folder)
                now.add(record_id(page), record(page, url, (html or "").encode(), size, digest, refers))
                if now.at >= ARCHIVE_BYTES:
                    done.append((*now.close(), now.at))
                    now = None
        if now is not None:
            done.append((*now.close(), now.at))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t.type) for k, t in enumerate(_MANIFEST)], schema=_MANIFEST)

    return run


def write_archives(pages: DataFrame, root: str, ws: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives and return their manifest (path, records, bytes)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))).cast("long")).withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    first = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # small payloads meet nothing; a key of their own keeps them spread
    key = F.when(F.col("size") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page").cast("string"), F.lit(""))))
    first = first.withColumnRenamed("digest", "key")
    placed = rows.withColumn("key", key).join(first, "key", "left")
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    ready = placed.select("page", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "size", "digest", refers.alias("refers"))
    size = pages.agg(F.sum(F.octet_length(html_col).cast("long"))).first()[0] or 0
    tasks = _tasks(pages.sparkSession, size, ARCHIVE_BYTES, SPAN_BYTES)
    return ws.put(ready.coalesce(tasks).mapInArrow(_writer(root), "path string, records long, bytes long"), "manifest")


_SPANS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("records", pa.int64())])


def _range_reader(file) -> zipdir.RangeReader:
    def read(start: int, length: int) -> bytes:
        file.seek(start)
        return file.read(length)

    return read


def _entry(line: bytes) -> dict:
    """An index line: JSON alone, or after a key and a time."""
    return json.loads(line[line.index(b"{") :])


def _index_lines(read: zipdir.RangeReader, index: zipdir.Member) -> Iterator[bytes]:
    at, rest = zipdir.data_start(read, index), b""
    stop = at + index.size
    while at < stop:
        chunk = read(at, min(1 << 20, stop - at))
        if not chunk:
            raise zipdir.BadArchive("an index is cut")
        at += len(chunk)
        *lines, rest = (rest + chunk).split(b"\n")
        yield from lines
    yield rest


def spans(read: zipdir.RangeReader, size: int) -> Iterator[tuple[int, int, int]]:
    """(start in the archive, length, records) of neighbouring records of all data members, as the indexes have them.

    Every byte of a data member must belong to one indexed record.
    """
    found = [m for m in zipdir.members(read, size) if not m.name.endswith("/")]
    data = [m for m in found if m.name.startswith("archive/")]
    indexes = [m for m in found if m.name.startswith("indexes/")]
    if odd := [m.name for m in data if not m.name.endswith(".warc.gz")] + [m.name for m in indexes if not m.name.endswith(".cdxj")]:
        raise zipdir.BadArchive(f"members that are not read: {odd[:5]}")
    number = {m.name: k for k, m in enumerate(data)} | {m.name.removeprefix("archive/"): k for k, m in enumerate(data)}
    entries = array("q")
    for index in indexes:
        for line in _index_lines(read, index):
            if not line.strip() or line.startswith(b"!"):
                continue
            entry = _entry(line)
            name = entry.get("filename", data[0].name if len(data) == 1 else None)
            if name not in number:
                raise zipdir.BadArchive(f"an index names {name}, which is not there")
            entries.extend((number[name], int(entry["offset"]), int(entry["length"])))
    table = np.frombuffer(entries, dtype=np.int64).reshape(-1, 3)
    for k, m in enumerate(data):
        base, own = zipdir.data_start(read, m), table[table[:, 0] == k]
        start, length, n = 0, 0, 0
        for _, offset, more in own[np.argsort(own[:, 1], kind="stable")].tolist():
            if offset != start + length or more <= 0 or offset + more > m.size:
                raise zipdir.BadArchive(f"the index does not fit {m.name}")
            if n and length + more > SPAN_BYTES:
                yield base + start, length, n
                start, length, n = offset, 0, 0
            length += more
            n += 1
        if start + length != m.size:
            raise zipdir.BadArchive(f"records of {m.name} that no index names")
        if n:
            yield base + start, length, n


def _locator(root: str):
    def run(batches):
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as file:
                    found = list(spans(_range_reader(file), file.size()))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), *(pa.array([s[k] for s in found], pa.int64()) for k in range(3))], schema=_SPANS)

    return run


def unpacked(raw: bytes, records: int) -> Iterator[bytes]:
    """The records of a span, one gzip member each."""
    view, at, n = memoryview(raw), 0, 0
    while at < len(raw):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if at == len(raw):
                raise zipdir.BadArchive("a record is cut")
            chunk = view[at : at + (1 << 14)]
            parts.append(unzip.decompress(chunk))
            at += len(chunk) - len(unzip.unused_data)
        n += 1
        yield b"".join(parts)
    if n != records:
        raise zipdir.BadArchive(f"{n} records where the index has {records}")


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.string())])


def _reader(root: str, with_payload: bool):
    def run(batches):
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, start, length, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as file:
                    raw = _range_reader(file)(start, length)
                rows = []
                for one in unpacked(raw, n):
                    warc, http, payload = parse(one)
                    digest = warc["warc-payload-digest"].removeprefix("sha256:")
                    kind, size = warc["warc-type"], int(http["content-length"])
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise zipdir.BadArchive(f"{warc['warc-record-id']} differs from its digest")
                    refers = warc.get("warc-refers-to")
                    rows.append((page_of(warc["warc-record-id"]), size, digest, kind, None if refers is None else page_of(refers), warc.get("warc-target-uri"), payload.decode() if with_payload and kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_RECORDS)], schema=_RECORDS)

    return run


def read_archives(manifest: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"
    spark = manifest.sparkSession
    there = manifest.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    located = manifest.select("path").repartition(_tasks(spark, there["n"], TASK_ARCHIVES, 1)).mapInArrow(_locator(root), "path string, start long, length long, records long")
    return located.repartition(_tasks(spark, there["bytes"] or 0, TASK_BYTES, SPAN_BYTES)).mapInArrow(_reader(root, with_payload), schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages as archives and read back a row for each; raises if any is missing."""
    ws = Workspace(spark, "warc")
    root = f"{ws.root}/archives"
    manifest = write_archives(pages, root, ws)
    out = ws.put(read_archives(manifest, root, with_payload=False).drop("payload", "url"), "records")
    written, found = manifest.agg(F.sum("records")).first()[0] or 0, out.count()
    if written != found:
        raise zipdir.BadArchive(f"{found} records of {written} came back")
    ws.drop("archives")
    return out


#: DuckDB SQL of the registered query
SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
