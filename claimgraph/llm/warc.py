"""WARC archives: written with an index, read by sorted, coalesced byte ranges.

Writing emits an index row per record (file, offset, length, URL, digest).  Reading starts from the index: the
selected records of a file are sorted by offset, neighbours are joined into ranges of at most ``RANGE_BYTES`` that
skip no more than ``GAP_BYTES``, and each range is read once.  A record is a gzip member of its own, so any
record can be read without the ones before it.

Of records with equal payloads (digest and length) of at least ``min_revisit_bytes``, that with the largest id is
a response and holds the payload; the others revisit it and hold none.  Equal payloads are found from
(digest, id) alone, pre-aggregated before the shuffle; a group that holds a third of all rows is one row of the
table of winners, and the join with it splits its partition at run time.

Defined cases: a null payload is empty; null and repeated ids are kept, each row a record; every row with the
winning id is a response, and a group without any id is all responses; a null URL is written as ``about:blank``
and control characters in URLs are percent-encoded; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_rows, opened, published, shared_dir, tune, written

FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
#: Any fixed date; a crawl's own would come from a column.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, file string, offset long, length long, url string, digest string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def decide(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Columns page_id, url, payload, refers_to; refers_to is null for responses."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "bytes": F.octet_length("payload").cast("long")})
    groups = keyed.groupBy("sha", "bytes").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    shared = written(groups.filter((F.col("n") > 1) & (F.col("bytes") >= min_revisit_bytes)).select("sha", "bytes", "winner"), "warc-winners")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("winner")), F.lit(None).cast("long")).otherwise(F.col("winner"))
    return keyed.join(shared, ["sha", "bytes"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()) if url is not None else b"about:blank"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target.decode()),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one uncompressed record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s or "")) else None
    kind = fields["WARC-Type"]
    declared = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != declared or digest_of(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": declared, "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def write_archives(decided: DataFrame, out: str) -> DataFrame:
    """Write the rows of ``decide`` to archives below ``out``; returns the index."""
    tune(decided.sparkSession)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (r for b in it for r in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), as_bytes(b, "payload"), b.column("refers_to").to_pylist(), strict=True))
        part, k, row = TaskContext.get().partitionId(), 0, next(rows, None)
        while row is not None:
            path, at, index = f"{out}/{part:06d}-{k:05d}.warc.gz", 0, []
            with published(path) as f:
                while row is not None and at < FILE_BYTES:
                    page_id, url, payload, refers = row
                    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = gz.compress(record(*row)) + gz.flush()
                    f.write(member)
                    index.append((page_id, path, at, len(member), url, digest_of(payload)))
                    at, row = at + len(member), next(rows, None)
            yield from index
            k += 1

    return map_rows(decided, write, INDEX)


def ranges(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Coalesce sorted (offset, length) spans; yields (start, end, which)."""
    start = end = 0
    which: list[int] = []
    for i, (offset, length) in enumerate(spans):
        if which and (offset - end > GAP_BYTES or offset + length - start > RANGE_BYTES):
            yield start, end, which
            which = []
        if not which:
            start = end = offset
        end = max(end, offset + length)
        which.append(i)
    if which:
        yield start, end, which


def read_records(index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Read the records that the index rows name, each file's in ascending order of offset."""
    n = max(1, index.sparkSession.sparkContext.defaultParallelism * 4)
    slices = index.select("file", "offset", "length").repartition(n, "file", F.expr(f"offset div {16 * RANGE_BYTES}")).sortWithinPartitions("file", "offset")

    def of_file(path: str, spans: list[tuple[int, int]]) -> Iterator[tuple]:
        with opened(path) as f:
            for start, end, which in ranges(spans):
                f.seek(start)
                data = f.read(end - start)
                for i in which:
                    offset, length = spans[i]
                    r = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    yield tuple(r.values())[:-1] + (r["payload"] if payloads else None,)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            spans: list[tuple[int, int]] = []
            last = None
            for path, *span in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if path != last and spans:
                    yield from of_file(last, spans)
                    spans = []
                last = path
                spans.append(tuple(span))
            if spans:
                yield from of_file(last, spans)

    return map_rows(slices, read, RECORD, 200 if payloads else 2000)


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages`` to archives; the index comes back as a written table."""
    decided = decide(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_revisit_bytes=min_revisit_bytes)
    return written(write_archives(decided, shared_dir(pages.sparkSession, "warc")), "warc-index")
