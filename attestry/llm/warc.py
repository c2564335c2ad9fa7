"""WARC archives with segmented records and revisits.

Pages become WARC/1.1 records: a response, or a revisit that points to the
response with the same payload. A block longer than SEGMENT is cut into a
first record and continuation records. Payloads travel in chunked framing.
Archives are written by Spark's own writer, one record a row, so any store
that Spark knows will do and a lost task leaves nothing behind: the line
separator is the two line ends after a WARC record.

Reading groups continuation records by the identifier of the record they
continue, orders them by segment number, verifies the total length and only
then decodes the framing. Records in one piece skip the grouping.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import BATCH_ROWS, Batches, broadcast_if_small, fresh_path, mapped, stage

#: Payloads of fewer bytes never revisit others.
LEAST_REVISIT = 1000
#: Most bytes of a block in one record.
SEGMENT = 32 * 1024
#: Most data bytes in one chunk of the framing.
CHUNK = 8 * 1024
#: Most records in one file. With SEGMENT it bounds the file, which is read whole.
FILE_RECORDS = 4096
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes) -> bytes:
    """The payload in HTTP's chunked framing."""
    out = bytearray()
    for at in range(0, len(payload), CHUNK):
        part = payload[at : at + CHUNK]
        out += b"%x\r\n%b\r\n" % (len(part), part)
    return bytes(out + b"0\r\n\r\n")


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped."""
    out, at = bytearray(), 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        if n == 0:
            return bytes(out)
        if framed[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out += framed[end + 2 : end + 2 + n]
        at = end + 4 + n


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, record_id: str) -> Iterator[bytes]:
    """The records of one page, without the line ends after each."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
        yield _record("revisit", record_id, [*fields, ("Content-Type", "application/http;msgtype=response")], f"{http}Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    fields.append(("Content-Type", "application/http;msgtype=response"))
    parts = [block[at : at + SEGMENT] for at in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        yield _record("response", record_id, fields, block)
        return
    yield _record("response", record_id, [*fields, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = hashlib.md5(f"{record_id}/{k}".encode()).hexdigest()
        more = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record("continuation", f"{own[:8]}-{own[8:12]}-{own[12:16]}-{own[16:20]}-{own[20:]}", more, part)


def plan(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The pages with payload, digest, record type and refers_to.

    Of the rows whose payloads are equal and of LEAST_REVISIT bytes or more,
    the one with the largest id is the response. Repeated rows with that id
    are responses too. Ids that are null count as the smallest, and where a
    group has no other id its rows are all responses. Digests are counted,
    without their pages, and those that two ids share are a written table. If
    it is small it is sent to the pages and none of them moves; otherwise they
    meet by exchange, which Spark can split where one digest has very many
    pages.
    """
    with_payload = pages.select(F.col(id_col).alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    with_payload = with_payload.withColumn("digest", F.sha1("payload"))
    shared = (
        with_payload.where(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy(F.col("digest").alias("shared_digest"))
        .agg(F.max("page_id").alias("response_id"), F.min("page_id").alias("least_id"), F.count_if(F.col("page_id").isNull()).alias("n_null"))
        .where((F.col("least_id") < F.col("response_id")) | ((F.col("n_null") > 0) & F.col("response_id").isNotNull()))
        .select("shared_digest", "response_id")
    )
    shared = broadcast_if_small(stage(shared, "warc-shared"), 64)
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return with_payload.join(shared, F.col("digest") == F.col("shared_digest"), "left").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("response_id")).alias("refers_to"), revisit.alias("is_revisit"), F.expr("uuid()").alias("record_id"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id") -> None:
    """Write all pages as gzip-compressed archives into the folder path."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "is_revisit", "record_id")))
            out = [r for row in rows for r in records(*row)]
            for at in range(0, len(out), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(out[at : at + BATCH_ROWS], pa.binary())], names=["record"])

    made = mapped(plan(pages, id_col), run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: header fields (lower-case names) and block."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        name = ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and name:
                fields[name] += " " + line.strip().decode("utf-8", "replace")
                continue
            key, _, value = line.decode("utf-8", "replace").partition(":")
            name = key.strip().lower()
            fields[name] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("an archive ends within a record")
        yield fields, block


def payload_of(block: bytes) -> tuple[int, bytes | None]:
    """Length and bytes of the payload of an HTTP block; a block without its body has no bytes."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = unchunked(body)
        return len(body), body
    return int(fields.get(b"content-length", len(body))), body or None


PART = "record_id string, segment int, total bigint, record_type string, page_id bigint, refers_to bigint, declared string, url string, payload_bytes bigint, block binary"
PAGE = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _finish(record_type: str, page_id: int | None, refers_to: int | None, declared: str, url: str, block: bytes) -> tuple:
    n, payload = payload_of(block)
    digest = declared
    if record_type == "response":
        digest = hashlib.sha1(payload or b"").hexdigest()
        if declared and digest != declared:
            raise ValueError(f"page {page_id}: the payload's digest is not the declared one")
    return page_id, url, n, digest, record_type, refers_to, payload if record_type == "response" else None


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], names=schema.names)


def read_parts(spark, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in a folder, each as one part.

    Without payloads, a record in one piece is decoded, verified and measured
    here, and its block goes no further.

    A file is read whole; FILE_RECORDS and SEGMENT bound it, and the session's
    bytes of an Arrow batch bound how many come at once.
    """
    schema = T._parse_datatype_string(PART)

    def run(batches: Batches) -> Batches:
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                raw = io.BytesIO(content.as_py())
                packed = raw.getbuffer()[:2] == b"\x1f\x8b"
                for f, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if packed else raw):
                    kind = f.get("warc-type", "")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    number = lambda k: int(f[k]) if f.get(k) else None
                    origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
                    segment, page, refers = number("warc-segment-number"), number("x-page-id"), number("x-refers-to-page-id")
                    declared, url, n = f.get("warc-payload-digest", "").removeprefix("sha1:").lower(), f.get("warc-target-uri", ""), None
                    if segment is None and not with_payload:
                        (_, _, n, declared, *_), block = _finish(kind, page, refers, declared, url, block), b""
                    rows.append((origin.strip("<>"), segment, number("warc-segment-total-length"), kind, page, refers, declared, url, n, block))
                    size += len(block)
                    if size >= 4 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                yield _batch(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return mapped(files.select("content"), run, schema)


def reassemble(parts: DataFrame, with_payload: bool = True) -> DataFrame:
    """The pages of records and their segments.

    A record that lacks a segment, or whose segments do not add up to the
    declared length, raises an error; nothing is passed over in silence. A
    group holds the segments of one record.
    """
    schema = T._parse_datatype_string(PAGE if with_payload else PAGE.removesuffix(", payload binary"))
    width = len(schema)

    def whole(batches: Batches) -> Batches:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            rows = zip(c["record_type"], c["page_id"], c["refers_to"], c["declared"], c["url"], c["block"], c["payload_bytes"])
            yield _batch([_finish(*r[:6])[:width] if r[6] is None else (r[1], r[4], r[6], r[3], r[0], r[2]) for r in rows], schema)

    def joined(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["segment"])
        total = rows[-1]["total"]
        block = b"".join(r["block"] for r in rows)
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or total is None or len(block) != total:
            raise ValueError(f"{rows[0]['record_id']}: segments are missing or don't add up")
        r = rows[0]
        return pa.Table.from_batches([_batch([_finish(r["record_type"], r["page_id"], r["refers_to"], r["declared"], r["url"], block)[:width]], schema)])

    alone = mapped(parts.where(F.col("segment").isNull()), whole, schema)
    return alone.unionByName(parts.where(F.col("segment").isNotNull()).groupBy("record_id").applyInArrow(joined, schema))


def archive_and_read(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write the pages to archives in the shared folder and read them back, without the payloads.

    A null html is an empty payload, a null url an empty one; an empty table
    gives an empty table; other columns are not read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, id_col)
    parts = stage(read_parts(spark, path, with_payload=False), "warc-parts")
    return reassemble(parts, with_payload=False)
