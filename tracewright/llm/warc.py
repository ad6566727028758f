"""WARC archives: writing pages, and a splittable reader (operator 9).

Each record is a gzip member of its own. A reading task has a byte range of one archive:
it looks for gzip's magic in it, takes a place for a member's start only if what decodes
from there begins with a WARC version line, and owns the records that start inside its
range, reading past its end for the last one. The next start is looked for behind the
end of the record, so magic inside compressed data is never met after a true start.

Archives lie in the shared folder and are opened through pyarrow's file systems by tasks.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import shared_dir, written

# The start of a gzip member with deflate, and of a record.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_CHUNK = 1 << 20


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, refers_url: str | None = None) -> bytes:
    """One gzip member. A revisit holds no payload, but its digest and length."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        head.append("Content-Type: application/http;msgtype=response")
        body += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}", "Content-Type: application/http;msgtype=response"]
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(digest, n, top) of each payload that several page ids share: its digest, its length
    in bytes and the largest id."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.sha1(F.encode(payload, "utf-8")).alias("digest"), F.octet_length(payload).alias("n"), "page_id")
    groups = keyed.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low"))
    return groups.where("low < top").select("digest", "n", "top")


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for each row of pages; returns (path, bytes, records) of the archives.

    Of pages with equal payloads of at least least_bytes bytes the largest id is the
    response and the others are revisits of it. A null html is an empty payload. A task
    names each file anew, and the list names only the files of tasks that ended well, so
    what a lost or repeated task has left isn't read."""
    where = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit(""))
    src = pages.select("page_id", "url", "html", F.sha1(F.encode(payload, "utf-8")).alias("digest"), F.octet_length(payload).alias("n"))
    # a payload that a third of the pages have is one row on the right; Spark splits the left side
    tops = revisits(pages, least_bytes)
    rows = src.join(tops, ["digest", "n"], "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("top"), F.col("top")).alias("refers_to"))

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        out = path = None
        size = n = 0
        done = []
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "bytes", "records"])

    listed = rows.mapInArrow(run, "path string, bytes long, records long").select(F.lit(where).alias("root"), "path", "bytes", "records")
    return written(listed, "warc-list")


_LENGTH = re.compile(rb"(?i)\r\ncontent-length: *\d+ *(?:\r\n|$)")


class _Source:
    """Random access to a file with one buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if not self.start <= place or place + n > self.start + len(self.data):
            self.file.seek(place)
            self.data, self.start = self.file.read(max(n, min(_CHUNK, self.size - place))), place
        return self.data[place - self.start : place - self.start + n]


def _member(src: _Source, place: int) -> tuple[bytes, int] | None:
    """Content of the gzip member at place and where it ends; None if none starts there,
    which shows as soon as the version line can be told."""
    un = zlib.decompressobj(31)
    parts, at, first = [], place, True
    while not un.eof:
        data = src.at(at, min(1 << 16, src.size - at))
        if not data:
            return None
        try:
            parts.append(un.decompress(data))
        except zlib.error:
            return None
        at += len(data)
        if first and sum(map(len, parts)) >= len(VERSION):
            first = False
            if not b"".join(parts).startswith(VERSION):
                return None
    content = b"".join(parts)
    # a whole member that isn't a record, however short, is passed over
    if not content.startswith(VERSION) or not _LENGTH.search(content.partition(b"\r\n\r\n")[0]):
        return None
    return content, at - len(un.unused_data)


def read_range(file, size: int, start: int, end: int):
    """Yield the contents of the records that start in [start, end)."""
    src, place = _Source(file, size), start
    while place < end:
        hit = -1
        while place < end:
            # magic that starts inside may end outside
            window = src.at(place, min(_CHUNK, end - place + 2, size - place))
            hit = window.find(MAGIC)
            if hit >= 0 or len(window) < 3:
                break
            place += len(window) - 2
            if place + 2 >= size:
                return
        if hit < 0 or place + hit >= end:
            return
        place += hit
        got = _member(src, place)
        if got is None:
            place += 1
            continue
        yield got[0]
        place = got[1]


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and payload of a record."""
    head, _, body = content.partition(b"\r\n\r\n")
    named = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        named[k.decode().lower()] = v.decode("utf-8", "surrogatepass").strip()
    block = body[: int(named["content-length"])]
    return named, block.partition(b"\r\n\r\n")[2]


def read_archives(listed: DataFrame, range_bytes: int = 8 << 20, html: bool = False, ids: str = "long") -> DataFrame:
    """The records of archives, each read by the task of the byte range that it starts in; ids is
    the type of the pages' ids."""
    ranges = listed.select("root", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    n = listed.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(max(1, math.ceil(n / 2)), "path", "start")

    def run(batches):
        for b in batches:
            for root, path, size, start in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                fs, _ = pafs.FileSystem.from_uri(root)
                out: list[tuple] = []
                with fs.open_input_file(path) as f:
                    for content in read_range(f, size, start, min(size, start + range_bytes)):
                        h, payload = parsed(content)
                        kind = h["warc-type"]
                        if kind == "response" and (len(payload) != int(h["x-payload-length"]) or _digest(payload) != h["warc-payload-digest"].removeprefix("sha1:")):
                            raise ValueError(f"damaged record of page {h['x-page-id']} in {path}")
                        page, other = h["x-page-id"], h.get("x-refers-to-page-id")
                        out.append((page or None, int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), kind, other or None, h["warc-target-uri"], payload.decode("utf-8", "surrogatepass") if html and kind == "response" else None))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"])

    found = ranges.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, html string")
    return found.withColumns({c: F.col(c).cast(ids) for c in ("page_id", "refers_to")})


def op9_warc(pages: DataFrame) -> DataFrame:
    """Write archives of all pages, read them back, and return page_id, payload_bytes,
    payload_digest, record_type and refers_to of each record.

    A null html is an empty payload. Rows that repeat an id with equal payloads are all
    responses if the id is the largest, else all revisits. Rows without id stay responses.
    Ids may be of any type that text keeps. An empty table gives no records."""
    ids = pages.schema["page_id"].dataType.simpleString()
    return read_archives(write_archives(pages), ids=ids).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHUNKS = ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, {5 * (k // 4) + 1}, 5) AS BIGINT) >> {15 - 5 * (k % 4)}) & 31) + 1 AS BIGINT), 1)" for k in range(32)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') t, sha1(coalesce(html, '')) h FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) payload_bytes, concat({_CHUNKS}) payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY t) THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN page_id < max(page_id) OVER (PARTITION BY t) THEN max(page_id) OVER (PARTITION BY t) END refers_to
FROM p
"""
