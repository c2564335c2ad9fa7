"""Media columns: content-addressed payloads in tar shards.

Each task writes one tar shard with a member for every different payload it
meets, named by the payload's SHA-256 digest. Rows carry digest, shard, offset
and length of the member's data. Width, height and bits come from range reads
of the first bytes of a member, and only what needs samples reads the rest.

A payload is stored as an 8-bit grey PNG of ROW samples a line: lossless, and
readable by any image library.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import Batches, fresh_path, mapped, stage, texts_of

#: Samples in a line of the picture; payloads are padded to a multiple of it.
ROW = 64
#: Bytes of a member that hold the signature and the IHDR chunk.
HEADER_BYTES = 33
#: Fixed value: how a PNG file begins.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Members this far apart are read in one go.
BLOCK = 512


def padded(raw: bytes) -> bytes:
    """The bytes, with zeros up to a positive multiple of ROW."""
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey picture, ROW wide; each line has filter type 0."""
    lines = len(payload) // ROW
    samples = np.zeros((lines, ROW + 1), np.uint8)
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(lines, ROW)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, lines, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 4)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from a member's first bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG picture")
    return struct.unpack(">IIB", first[16:25])


def from_png(stored: bytes) -> bytes:
    """The samples of a picture that to_png() made, with all checksums verified."""
    width, height, bits = png_header(stored)
    at, data = 8, []
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError(f"checksum of chunk {kind!r} differs")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if bits != 8 or width != ROW:
        raise ValueError("not a picture of this module")
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """A summary of the samples: lines, mean, deviation, share of zeros, mean step, entropy in bits."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    return f"lines={len(x) // ROW};mean={x.mean():.3f};dev={x.std():.3f};zero={share[0]:.5f};step={step:.3f};bits={entropy:.4f}"


#: What Spark and Arrow call the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "wasbs": "abfss"}
#: Bytes of members that a task reads back.
TASK_BYTES = 64 << 20


class _Store:
    """Files of the shared folder, by URI or by plain path; stores as Arrow's file systems reach them."""

    def __init__(self, root: str):
        scheme, colon, rest = root.partition(":")
        uri = f"{SCHEMES.get(scheme, scheme)}{colon}{rest}"
        self.files, self.root = fs.FileSystem.from_uri(uri) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)

    def write(self, name: str):
        self.files.create_dir(self.root, recursive=True)
        return self.files.open_output_stream(f"{self.root}/{name}")

    def read(self, name: str):
        return self.files.open_input_file(f"{self.root}/{name}")


INDEX = "digest string, shard string, offset bigint, length bigint, n_bytes bigint, payload_bytes bigint"


def write_shards(docs: DataFrame, root: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store each row's payload under root and return the index: the id and INDEX.

    The payload is the text in UTF-8, padded; a null text is an empty one and
    gives ROW zeros. Within a shard each different payload is stored once, so a
    task keeps the digests of its own input in memory and no payload. The
    returned frame writes when it is evaluated: stage it once. A task that is
    tried again writes a new shard, and only shards in the index count.
    """
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string(INDEX).fields])

    def run(batches: Batches) -> Batches:
        store, shard, out, at, have = _Store(root), f"shard-{uuid.uuid4().hex}.tar", None, 0, {}
        try:
            for b in batches:
                rows = []
                for text in texts_of(b, text_col):
                    raw = text.encode()
                    payload = padded(raw)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in have:
                        if out is None:
                            out = store.write(shard)
                        stored = to_png(payload)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(stored)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + stored + bytes(-len(stored) % BLOCK))
                        have[digest] = (at + len(head), len(stored))
                        at += len(head) + len(stored) + -len(stored) % BLOCK
                    rows.append((digest, shard, *have[digest], len(raw), len(payload)))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))] if rows else None
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(id_col), *columns], names=schema.names)
        finally:
            if out is not None:
                out.write(bytes(2 * BLOCK))
                out.close()

    return mapped(docs.select(id_col, text_col), run, schema)


def read_metadata(index: DataFrame, root: str) -> DataFrame:
    """The index with width, height and bits, from range reads of each member's first bytes."""
    schema = T.StructType([*index.schema.fields, *T._parse_datatype_string("width int, height int, bits int").fields])

    def run(batches: Batches) -> Batches:
        store = _Store(root)
        for b in batches:
            got = []
            for name, rows in _by_shard(b).items():
                with store.read(name) as f:
                    got += [(i, *png_header(f.read_at(min(HEADER_BYTES, n), at))) for i, at, n in rows]
            got.sort()
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[k] for g in got], pa.int32()) for k in (1, 2, 3))], names=schema.names)

    return mapped(index, run, schema)


def _by_shard(b: pa.RecordBatch) -> dict[str, list[tuple[int, int, int]]]:
    """shard -> (row, offset, length), in order of offset."""
    out: dict[str, list[tuple[int, int, int]]] = {}
    for i, (name, at, n) in enumerate(zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist())):
        out.setdefault(name, []).append((i, at, n))
    for rows in out.values():
        rows.sort(key=lambda r: r[1])
    return out


def spread(index: DataFrame) -> DataFrame:
    """The index dealt to as many tasks as the members' bytes are worth, neighbours in a shard together and in order."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return index.repartition(tasks, "shard", F.floor(F.col("offset") / (TASK_BYTES // 8))).sortWithinPartitions("shard", "offset")


def read_back(index: DataFrame, root: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of an index with metadata: what the stored bytes hold.

    payload_sha256 and tail_crc32 (of the last ROW bytes) are of the samples
    read back, media_bytes and media_sha256 of the stored form. A payload that
    does not have the digest by which it is addressed raises an error.
    """
    schema = T.StructType([index.schema[id_col], *T._parse_datatype_string("n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int").fields])

    def run(batches: Batches) -> Batches:
        store = _Store(root)
        for b in batches:
            digests, rows, last = b.column("digest").to_pylist(), [], (None, None)
            for name, members in _by_shard(b).items():
                with store.read(name) as f:
                    for i, at, n in members:
                        if last[0] != (name, at):
                            stored = f.read_at(n, at)
                            payload = from_png(stored)
                            digest = hashlib.sha256(payload).hexdigest()
                            last = ((name, at), (len(payload), digest, zlib.crc32(payload[-ROW:]), n, hashlib.sha256(stored).hexdigest(), feature(payload)))
                        if last[1][1] != digests[i]:
                            raise ValueError(f"{name} at {at}: the payload is not the one of digest {digests[i]}")
                        rows.append((i, last[1]))
            rows.sort()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("n_bytes"), *(pa.array([r[1][k] for r in rows], t) for k, t in enumerate(kinds)), b.column("width"), b.column("height")], names=schema.names)

    return mapped(index.select(id_col, "digest", "shard", "offset", "length", "n_bytes", "width", "height"), run, schema)


def store_and_read(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store all payloads in the shared folder, then read them back: first the heads for metadata, then the samples.

    Null and empty texts are a payload of ROW zeros; repeated texts give equal
    values; very long texts are one payload; an empty table gives an empty
    table; other columns are not read.
    """
    root = fresh_path(docs.sparkSession, "media")
    index = stage(write_shards(docs, f"{root}/shards", text_col, id_col), "media-index")
    return read_back(read_metadata(spread(index), f"{root}/shards"), f"{root}/shards", id_col)
