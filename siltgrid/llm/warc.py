"""WARC archives, index first.

Writing: each task appends gzip members, one per record, to an archive of its own in the shared
folder, and gives back an index row for each: page, file, offset, length, url, digest, record type.
The file's name is new for each attempt, and only rows of attempts that Spark commits name it, so a
lost executor leaves at most an archive that no index row names. Records of equal payloads are
decided before writing: the one with the largest page id is a response, the others are revisits
that hold the HTTP header alone.

Reading: index rows are sorted by file and offset, neighbouring byte ranges are coalesced up to a
bounded size, and each range is read at once and cut into its records.

Payload groups are aggregated by digest before anything is joined; a group of copies of any size is
one row there. A null html has an empty payload. Pages that share an id stay separate records, each
judged by its own payload; one without an id is a response. Pages that share id and payload get the
same verdict. Urls and texts of any length are written whole; other columns are not read. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
#: Bytes from which a coalesced read ends, the gap that it may bridge, and that of an archive.
READ_BYTES, GAP_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 256 << 20
#: Archive bytes that a reading task takes, at most (about) and at least, where the cluster has tasks to spare.
TASK_BYTES, LEAST_TASK_BYTES = 128 << 20, 4 << 20


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the given page's response: its block ends after the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{bare_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers of a record and its HTTP block's payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {"fields": fields, "payload": payload, "payload_bytes": size}


def decide(pages: DataFrame, key: str = "page_id", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(key, digest, refers_to) of the pages that revisit another; pages of equal payloads of at least so many bytes form a group."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(key, F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).filter((F.col("size") >= least_bytes) & F.col(key).isNotNull())
    groups = rows.groupBy("digest").agg(F.max(key).alias("refers_to"), F.min(key).alias("least")).filter("least < refers_to").select("digest", "refers_to")
    groups = common.small_side(common.saved(groups, "payload-groups"))
    return rows.join(groups, "digest").filter(F.col(key) < F.col("refers_to")).select(key, "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages, with their refers_to, to archives under the folder; gives the index, to be stored before it is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        for batch in batches:
            rows = []
            for page, link, text, refers in zip(*(batch.column(i) for i in range(4))):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = text.as_buffer().to_pybytes()
                member = gzip.compress(record_bytes(page.as_py(), link.as_py(), payload, refers.as_py()), 3, mtime=0)
                out.write(member)
                rows.append((name, at, len(member), page.as_py(), link.as_py(), bare_digest(payload), "revisit" if refers.is_valid else "response"))
                at += len(member)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        if out is not None:
            out.close()

    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    return pages.select(F.col(key).cast("long"), F.col(url), payload, F.col("refers_to").cast("long")).mapInArrow(common.tidied(run), INDEX)


def coalesced(ranges: list[tuple[int, int]], most: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, numbers of the ranges inside) of joint reads; ranges are sorted."""
    inside: list[int] = []
    start = end = 0
    for i, (offset, length) in enumerate(ranges):
        if inside and (offset - end > gap or offset + length - start > most):
            yield start, end, inside
            inside = []
        if not inside:
            start = offset
        inside.append(i)
        end = max(end, offset + length) if len(inside) > 1 else offset + length
    if inside:
        yield start, end, inside


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that the stored index's rows name, and check what they hold against their digests and sizes: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        open_name, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            edges = [0, *(i for i in range(1, len(rows)) if rows[i][0] != rows[i - 1][0]), len(rows)]
            for a, b in zip(edges, edges[1:]):
                if rows[a][0] != open_name:
                    open_name = rows[a][0]
                    source = store.open_input_file(f"{root}/{open_name}")
                for start, end, inside in coalesced([(o, n) for _, o, n in rows[a:b]]):
                    block, out = source.read_at(end - start, start), []
                    for i in inside:
                        _, offset, length = rows[a + i]
                        found = parse_record(zlib.decompress(block[offset - start : offset - start + length], 31))
                        f = found["fields"]
                        refers = f.get("X-Refers-To-Page-ID")
                        if f["WARC-Type"] == "response" and (len(found["payload"]) != found["payload_bytes"] or f["WARC-Payload-Digest"] != f"sha1:{bare_digest(found['payload'])}"):
                            raise ValueError(f"{open_name} at {offset}: the payload is not the one that its record names")
                        page = f.get("X-Page-ID")
                        out.append((None if page is None else int(page), f["WARC-Target-URI"], found["payload_bytes"], f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], None if refers is None else int(refers), found["payload"]))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, total // LEAST_TASK_BYTES))
    ranges = index.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(common.tidied(run), schema)


def write_and_index(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write all pages; the stored index and the archives' folder."""
    folder = common.scratch(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    digest = F.sha1(F.coalesce(F.col(html).cast("binary"), F.lit(b"")))
    marked = pages.select(key, url, html, digest.alias("digest")).join(decide(pages, key, html, least_bytes), [key, "digest"], "left")
    return common.saved(write_archives(marked, folder, key, url, html), "warc-index"), folder


def op10_index_first(spark, sf_dir: str) -> DataFrame:
    index, folder = write_and_index(common.table(spark, sf_dir, "pages"))
    read = read_records(index, folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = "0123456789abcdef"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY sha1(html)) AS last FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: list_reduce(list_transform(range(5), lambda j: strpos('{_DIGITS}', substr(h, (1 + 5 * i + j)::INT, 1)) - 1), lambda a, b: a * 16 + b)) AS g FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{_BASE32}', (1 + (g[(k // 4 + 1)::INT] // (32 ^ (3 - k % 4))::BIGINT) % 32)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM v"""


QUERIES = {"op10_index_first": op10_index_first}
ORACLES = {"op10_index_first": _SQL}
