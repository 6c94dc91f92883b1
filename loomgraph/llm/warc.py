"""WARC archives, index first: offset, length, URL and digest of every record are written, then sorted byte ranges of
the selected records are coalesced into few reads.

Records are gzip members of their own (WARC/1.1). Equal payloads are found by SHA-1, length and a second hash: the smallest page id holds the
response, others are revisits of it. Files have names of their own for each attempt of a task and are only found
through the written index, so a repeated or lost task leaves at most an unused file.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import new_path, open_uri, partitions, small_batches, written

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
#: Ranges of one file at most so far apart are read at once, up to so many bytes.
GAP, READ = 64 << 10, 8 << 20
_ROLL = 256 << 20
_ZERO_DATE = "1970-01-01T00:00:00Z"


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str = _ZERO_DATE) -> bytes:
    """One WARC record, not compressed. A revisit has the HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uid = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {uid(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url or 'urn:none')}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {uid(first)}", f"X-Refers-To-Page: {first}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, bytes]:
    """Header fields of a record and its payload (empty for a revisit); checks the payload's digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    return fields, payload


def sha1_base32(payload: bytes) -> str:
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(folder: str, level: int):
    def run(batches):
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        out, at, k, rows = None, 0, 0, []

        def index():
            """The rows of a file, once it is closed."""
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([dict(zip(_INDEX_ARROW.names, x)) for x in rows[i : i + 10_000]], schema=_INDEX_ARROW)
            rows.clear()

        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if out is None or at >= _ROLL:
                        if out is not None:
                            out.close()
                            yield from index()
                        file, at, k = f"{name}-{k:04d}.warc.gz", 0, k + 1
                        out = open_uri(file, "w")
                    payload = (r["html"] or "").encode()
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    revisit = r["first"] is not None and r["page_id"] != r["first"]
                    press = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = press.compress(record(r["page_id"], r["url"], payload, digest, r["first"], revisit)) + press.flush()
                    out.write(raw)
                    rows.append((file, at, len(raw), r["url"], digest, r["page_id"], "revisit" if revisit else "response"))
                    at += len(raw)
        finally:
            if out is not None:
                out.close()
        yield from index()

    return run


_INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, folder: str | None = None, level: int = 1) -> DataFrame:
    """Write a record for each page; returns the written index (file, offset, length, url, digest, page_id, record_type).

    A null html is an empty payload; a null url becomes 'urn:none'; a page with null id is always a response unless
    its payload occurs with an id; rows that share the smallest id of a payload are all responses; an empty table
    writes no file; other columns are ignored. Payloads under min_revisit_bytes are always responses.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    same = ["sha1", "size", "mark"]  # SHA-1 alone has known collisions
    pages = pages.select("*", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"), F.xxhash64(payload).alias("mark"))
    firsts = pages.where(F.col("size") >= min_revisit_bytes).groupBy(*same).agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    ready = pages.join(firsts, same, "left").select("page_id", "url", "html", "sha1", "first")
    return written(ready.mapInArrow(_write(folder, level), INDEX), "warc-index")


def _read(batches):
    file, start, run = None, 0, []

    def fetch():
        with open_uri(file, "r") as f:
            f.seek(start)
            raw = f.read(run[-1][0] + run[-1][1] - start)
        rows, size = [], 0
        for offset, length in run:
            if size > READ:  # what a range holds uncompressed may be far more than its bytes
                yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)
                rows, size = [], 0
            fields, payload = parse(zlib.decompress(raw[offset - start : offset - start + length], 31))
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and sha1_base32(payload) != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
            size += len(payload)
            page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
            rows.append({"page_id": page and int(page), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers and int(refers)})
        yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)

    for batch in batches:
        for r in batch.to_pylist():
            end = run[-1][0] + run[-1][1] if run else 0
            if run and (r["file"] != file or r["offset"] - end > GAP or r["offset"] + r["length"] - start > READ):
                yield from fetch()
                run = []
            if not run:
                file, start = r["file"], r["offset"]
            run.append((r["offset"], r["length"]))
    if run:
        yield from fetch()


_READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_warc(selected: DataFrame) -> DataFrame:
    """The records of index rows (file, offset, length), by sorted byte ranges that lie close together read at once.

    Returns page_id, url, payload (empty for a revisit), payload_bytes, payload_digest, record_type and refers_to.
    """
    ranges = selected.select("file", "offset", "length").repartitionByRange(partitions(selected.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
