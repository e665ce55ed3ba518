"""WARC archives with a two-level capture index.

Records are written by the tasks that hold the pages, one gzip member each, to the shared folder. The index is sorted by
reversed-host key, cut into compressed blocks, and a sparse directory keeps the first key of every block. A lookup
finds the shard, then the block by binary search in the directory, then the line in the block, and reads one byte range.
Only files named by a committed row are read back, so an attempt that died leaves nothing but an unused file.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescore.llm.common import query, table, written
from placescore.session import scratch_path

#: Payloads below this size are always stored, as a revisit would save nothing.
MIN_REVISIT_BYTES = 100
LINES_PER_BLOCK = 1_000
LINES_PER_SHARD = 100_000
#: A file is closed and another begun beyond this size.
FILE_BYTES = 1 << 30
LINES = "key string, file string, at bigint, size bigint"
CAPTURES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def shared_files(path: str):
    """(file system, path in it) of a folder that every executor reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://", path) else (fs.LocalFileSystem(), path.removeprefix("file:"))


def capture_key(url: str | None, page_id: int | None) -> str:
    """Reversed host, path and id: sorts the captures of a site together. A null id sorts first."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)", url or "", re.S)
    host, rest = (m[1].lower(), m[2]) if m else ("", url or "")
    name, _, port = host.partition(":")
    shown = ",".join(reversed(name.strip(".").split("."))) + (f":{port}" if port else "")
    return f"{shown}){rest} " + ("-" if page_id is None else f"{page_id + (1 << 63):020d}")


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record, uncompressed. A revisit keeps the response's head, not its payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page_id, payload bytes, payload digest, type, refers_to) of one record; a stored payload is digested again."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number("WARC-Record-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To")


def with_decisions(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Add digest, type and the page a revisit refers to: of equal payloads the smallest id is stored."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    large = F.octet_length("html") >= MIN_REVISIT_BYTES
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record below ``folder``; returns the index lines (key, file, at, size)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared_files(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                lines = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    kind = "response" if refers_to is None else "revisit"
                    member = gzip.compress(record(page_id, url, html.encode("utf-8", "replace"), digest, kind, refers_to), 5, mtime=0)
                    out.write(member)
                    lines.append((capture_key(url, page_id), name, at, len(member)))
                    at += len(member)
                if lines:
                    keys, files, ats, sizes = zip(*lines, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.string()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return with_decisions(pages, id_col, url_col, html_col).mapInArrow(write, LINES)


def write_index(lines: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Sort the lines into shards of compressed blocks, each with a sparse directory; returns (first key, shard), sorted.

    That list has a row per LINES_PER_SHARD captures.
    """
    shards = max(1, -(-lines.count() // LINES_PER_SHARD))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared_files(folder)
        fs.create_dir(path, recursive=True)
        name, at, directory, held = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, [], []
        out = None

        def flush():
            nonlocal out, at, held
            if held:
                out = out or fs.open_output_stream(f"{path}/{name}.blocks")
                packed = zlib.compress("\n".join(json.dumps(x) for x in held).encode())
                out.write(packed)
                directory.append((held[0][0], at, len(packed)))
                at, held = at + len(packed), []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(line)
                if len(held) == LINES_PER_BLOCK:
                    flush()
        flush()
        if directory:
            out.close()
            with fs.open_output_stream(f"{path}/{name}.directory") as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], names=["first", "shard"])

    ordered = lines.repartitionByRange(shards, "key").sortWithinPartitions("key", "file", "at")
    rows = written(ordered.mapInArrow(build, "first string, shard string"), "warc-shards").collect()
    return sorted((r["first"], r["shard"]) for r in rows)


def look_up(wanted: DataFrame, shards: list[tuple[str, str]], folder: str) -> DataFrame:
    """(file, at, size) of every wanted (url, page_id); what the index does not hold is left out."""
    firsts = [s[0] for s in shards]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared_files(folder)
        shard = block = directory = entries = names = None
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                s = bisect.bisect_right(firsts, key) - 1
                if s < 0:
                    continue
                if s != shard:
                    shard, block = s, None
                    with fs.open_input_stream(f"{path}/{shards[s][1]}.directory") as f:
                        directory = json.loads(f.read())
                b = bisect.bisect_right(directory, key, key=lambda d: d[0]) - 1
                if b < 0:
                    continue
                if b != block:
                    block, (_, at, size) = b, directory[b]
                    with fs.open_input_file(f"{path}/{shards[s][1]}.blocks") as f:
                        entries = [json.loads(x) for x in zlib.decompress(f.read_at(size, at)).split(b"\n")]
                    names = [e[0] for e in entries]
                i = bisect.bisect_right(names, key) - 1
                if i >= 0 and names[i] == key:
                    found.append(entries[i][1:])
            if found:
                files, ats, sizes = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "at", "size"])

    keyed = wanted.mapInArrow(keys, "key string")
    return keyed.repartition(F.substring("key", 1, 12), F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(16))).sortWithinPartitions("key").mapInArrow(find, "file string, at bigint, size bigint")


def read_ranges(places: DataFrame, folder: str) -> DataFrame:
    """Read and parse the record at every place, file by file in ascending order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared_files(folder)
        name, f = None, None
        for batch in batches:
            rows = []
            for file, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{path}/{file}")
                rows.append(parse(gzip.decompress(f.read_at(size, at))))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return places.repartition("file", F.floor(F.col("at") / (1 << 24))).sortWithinPartitions("file", "at").mapInArrow(read, CAPTURES)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages, index them, look every page up and read its record back.

    Null html is an empty payload; a null or strange URL is stored escaped; very long pages are one record. Of equal
    payloads of at least MIN_REVISIT_BYTES the smallest id is the response; rows repeated with that id are responses too.
    A null id never becomes the response of others. An empty table gives an empty result; other columns are not read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    lines = written(write_archives(pages, f"{folder}/archive", id_col, url_col, html_col), "warc-lines")
    shards = write_index(lines, f"{folder}/index")
    wanted = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return read_ranges(look_up(wanted, shards, f"{folder}/index"), f"{folder}/archive")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


@query("op10_warc", SQL)
def op10(spark, sf):
    return archive_and_read(table(spark, sf, "pages"))
