"""WARC archives with a two-level capture index.

Records are gzip members of archive files, one file per task. The first index level holds capture lines
sorted by reversed-host URL key and page in compressed blocks; the second is a sparse directory with one row per block. A
capture that is asked for finds its block by binary search in the directory and its line by binary search in the block, and only
then is the byte range of its record read. Files are written through the file system that the folder's URI names, so executors need no common disk.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kit

#: Bytes after which an archive file is closed and another begun.
ARCHIVE_BYTES = 1 << 28
#: Capture lines in a compressed block of the index.
BLOCK_LINES = 1024
#: Bytes of an archive that one task reads back, and bytes of one range read.
STRETCH, READ = 1 << 26, 1 << 22
#: Cells of the directory that requests are dealt into; stands for a page without a number.
CELLS, LEAST = 4096, -(1 << 63)
DATE = "2000-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, file string, at long, size long"
#: Directory rows (asks = 0) and requests (asks = 1), dealt into cells.
_DEALT = "cell int, asks int, key string, page_id long, last string, last_page long, file string, at long, size long"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,blog)/a?b``. Without ``://`` the whole lower-cased text; null is empty."""
    if not url:
        return ""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return url.lower()
    m = re.match(r"[^/?#]*", rest)
    host, tail = m[0].rpartition("@")[2].lower(), rest[m.end() :].partition("#")[0]
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/")


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + (b"" if revisit else payload) + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member; the stated lengths are checked."""
    text = zlib.decompress(data, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} isn't {size} bytes long")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def page(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), the payload of a response checked against its digest."""
    fields, http, payload = parse(data)
    kind, digest, number = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), lambda k: int(fields[k]) if k in fields else None
    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"record {fields['WARC-Record-ID']} differs from its digest")
    return number("X-Page-ID"), int(http["Content-Length"]), digest, kind, number("X-Refers-To-Page-ID")


def _batch(rows: list, names: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    cols = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(cols)], names=[n for n, _ in cols])


class Archive:
    """Files of one task, each begun when needed and closed at ``limit`` bytes. A repeated attempt writes files of its own; only those it reports are ever read."""

    def __init__(self, folder: str, prefix: str, suffix: str, limit: int) -> None:
        self.fs, self.base = file_system(folder)
        self.folder, self.stem, self.suffix, self.limit, self.n, self.out = folder, f"{prefix}-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", suffix, limit, 0, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name, self.n, self.at = f"{self.stem}-{self.n:04d}{self.suffix}", self.n + 1, 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.out.write(data)
        place = self.name, self.at, len(data)
        self.at += len(data)
        if self.at >= self.limit:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record per row and return its capture: (key, page_id, file, at, size).

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is a response
    and the others revisit it; rows that share that page_id are all responses, as are smaller payloads. Null html is an
    empty payload; a null page_id counts as smallest and is left out of its record, a null url too;
    an empty table writes nothing. Other columns are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha"))
    last = rows.select("sha", "page_id").groupBy("sha").agg(F.max("page_id").alias("last"))
    rows = rows.join(last, "sha").select("page_id", "url", F.col("payload").cast("binary").alias("payload"), "sha", "last", (~F.col("page_id").eqNullSafe(F.col("last")) & (F.octet_length("payload") >= least)).alias("revisit"))

    def run(batches):
        out = Archive(folder, "pages", ".warc.gz", ARCHIVE_BYTES)
        try:
            for b in batches:
                found = []
                for k in range(b.num_rows):
                    page_id, url, body, sha, last_id, revisit = (b.column(c)[k].as_py() for c in range(6))
                    data = record(page_id, url, body, base64.b32encode(bytes.fromhex(sha)).decode(), last_id if revisit else None, revisit)
                    found.append((_clean(url_key(url)), page_id, *out.add(data)))
                yield _batch(found, CAPTURE)
        finally:
            out.close()

    return kit.stage(rows.mapInArrow(kit.tidy(run), CAPTURE), "captures")


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures by (key, page_id) into compressed blocks and return the directory: the first and last capture of each block, and its place."""
    spark = captures.sparkSession
    directory = "first string, first_page long, last string, last_page long, file string, at long, size long, lines long"

    def run(batches):
        out, lines = Archive(folder, "index", ".cdx.gz", ARCHIVE_BYTES), []

        def block():
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress("".join(f"{' '.join(map(str, x))}\n" for x in lines).encode()) + packer.flush()
            found = (*_capture(lines[0]), *_capture(lines[-1]), *out.add(data), len(lines))
            lines.clear()
            return found

        try:
            for b in batches:
                found = []
                for key, page_id, *place in zip(*(b.column(c).to_pylist() for c in range(5))):
                    lines.append((key, "-" if page_id is None else page_id, *place))
                    if len(lines) == BLOCK_LINES:
                        found.append(block())
                yield _batch(found, directory)
            if lines:
                yield _batch([block()], directory)
        finally:
            out.close()

    ordered = captures.repartitionByRange(kit.n_parts(spark), "key", "page_id").sortWithinPartitions("key", "page_id")
    return kit.stage(ordered.mapInArrow(kit.tidy(run), directory), "directory")


def _lines(source, base: str, file: str, at: int, size: int) -> list[list[str]]:
    with source.open_input_file(f"{base}/{file}") as f:
        return [x.split(" ") for x in zlib.decompress(f.read_at(size, at), 31).decode().split("\n")[:-1]]


def _capture(line: list) -> tuple[str, int]:
    """What captures are sorted by: the key, then the page; one without a number comes first."""
    return line[0], LEAST if line[1] in (None, "-") else int(line[1])


def requests(pages: DataFrame) -> DataFrame:
    """(key, page_id) of the captures of all pages."""

    def run(batches):
        for b in batches:
            yield _batch([(_clean(url_key(u)), LEAST if p is None else p) for u, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], "key string, page_id long")

    return pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(kit.tidy(run), "key string, page_id long").distinct()


def _borders(directory: DataFrame) -> list[tuple[str, int]]:
    """At most about 2 * CELLS captures that cut the directory into cells, from a sample by hash (they shape the load only)."""
    n = directory.count()
    rows = directory.select("last", "last_page", F.pmod(F.xxhash64("file", "at"), F.lit(1 << 30)).alias("h"))
    return sorted((r[0], r[1]) for r in rows.where(F.col("h") < int((1 << 30) * min(1.0, CELLS / max(1, n)))).limit(4 * CELLS).collect())


def places(asked: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """(file, at, size) of the records of (key, page_id) captures. Both the directory and the requests are dealt into cells by a few borders; in a cell
    a request binary-searches the directory, then the lines of its block, which is read once for all requests that it may hold."""
    spark = directory.sparkSession
    n, borders = kit.n_parts(spark), _borders(directory)

    def of_requests(batches):
        for b in batches:
            yield _batch([(bisect.bisect_left(borders, (k, p)), 1, k, p, k, p, None, None, None) for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], _DEALT)

    def of_blocks(batches):
        for b in batches:
            found = []
            for k, p, k2, p2, *place in zip(*(b.column(c).to_pylist() for c in range(7))):
                found += [(c, 0, k, p, k2, p2, *place) for c in range(bisect.bisect_left(borders, (k, p)), bisect.bisect_left(borders, (k2, p2)) + 1)]
            yield _batch(found, _DEALT)

    def search(batches):
        source, base = file_system(folder)
        cell, blocks, last, held, lines = None, [], [], None, []
        for b in batches:
            found = []
            for c, asks, k, p, k2, p2, *place in zip(*(b.column(c).to_pylist() for c in range(9))):
                if c != cell:
                    cell, blocks, last, held = c, [], [], None
                if not asks:
                    blocks.append(((k, p), place)), last.append((k2, p2))
                    continue
                at = bisect.bisect_left(last, (k, p))
                while at < len(blocks) and blocks[at][0] <= (k, p):
                    if held != at:
                        held, lines = at, _lines(source, base, *blocks[at][1])
                    x = bisect.bisect_left(lines, (k, p), key=_capture)
                    while x < len(lines) and _capture(lines[x]) == (k, p):
                        found.append((lines[x][2], int(lines[x][3]), int(lines[x][4])))
                        x += 1
                    at += 1
            yield _batch(found, "file string, at long, size long")

    blocks = directory.select("first", "first_page", "last", "last_page", "file", "at", "size").mapInArrow(kit.tidy(of_blocks), _DEALT)
    dealt = asked.select("key", "page_id").mapInArrow(kit.tidy(of_requests), _DEALT).unionAll(blocks)
    return kit.dealt(dealt, n, "cell", "asks", "key", "page_id", "last", "last_page").mapInArrow(kit.tidy(search), "file string, at long, size long")


def records(found: DataFrame, folder: str) -> DataFrame:
    """The records at (file, at, size) places, read by byte range in file order."""

    def run(batches):
        source, base = file_system(folder)
        name, f, buf, start = None, None, b"", 0
        try:
            for b in batches:
                out = []
                for file, at, size in zip(*(b.column(c).to_pylist() for c in range(3))):
                    if file != name:
                        if f is not None:
                            f.close()
                        name, f, buf, start = file, source.open_input_file(f"{base}/{file}"), b"", 0
                    if not start <= at <= at + size <= start + len(buf):
                        start, buf = at, f.read_at(max(READ, size), at)
                    out.append(page(buf[at - start : at - start + size]))
                    if len(out) == 4096:
                        yield _batch(out, PAGE)
                        out = []
                yield _batch(out, PAGE)
        finally:
            if f is not None:
                f.close()

    stretch = F.floor(F.col("at") / STRETCH)
    return found.repartition(kit.n_parts(found.sparkSession), "file", stretch).sortWithinPartitions("file", "at").mapInArrow(kit.tidy(run), PAGE)


def lookup(directory: DataFrame, folder: str, urls: list[str]) -> DataFrame:
    """Records of a few URLs: directory rows by key range, binary search in their blocks, then one range read per capture."""
    keys = sorted({_clean(url_key(u)) for u in urls})

    def run(batches):
        source, base = file_system(folder)
        for b in batches:
            found = []
            for first, last, file, at, size in zip(*(b.column(c).to_pylist() for c in range(5))):
                lines = _lines(source, base, file, at, size)
                for key in keys[bisect.bisect_left(keys, first) : bisect.bisect_right(keys, last)]:
                    for k in range(bisect.bisect_left(lines, key, key=lambda x: x[0]), bisect.bisect_right(lines, key, key=lambda x: x[0])):
                        with source.open_input_file(f"{base}/{lines[k][2]}") as f:
                            found.append((key, *page(f.read_at(int(lines[k][4]), int(lines[k][3])))))
            yield _batch(found, f"key string, {PAGE}")

    hit = F.lit(False)
    for key in keys:
        hit |= (F.col("first") <= key) & (F.col("last") >= key)
    return directory.where(hit).select("first", "last", "file", "at", "size").mapInArrow(kit.tidy(run), f"key string, {PAGE}")


def archive(pages: DataFrame, least: int = 0) -> tuple[DataFrame, str]:
    """Write and index all pages in a new folder of the shared ones; returns the directory and the folder."""
    folder = kit.scratch_path(pages.sparkSession, "warc")
    jvm = pages.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return index(write(pages, folder, least), folder), folder


def read(pages: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """The records of the captures of all rows of pages, each found through the index."""
    return records(places(requests(pages), directory, folder), folder)


def op10(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read(pages, *archive(pages))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> ((3 - i % 4) * 5)::INTEGER) & 31) + 1), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
