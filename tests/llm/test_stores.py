"""Media shards and WARC archives: exact round trips."""

import gzip
import hashlib
import io
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from attestry.llm import media, warc
from attestry.llm.common import fresh_path


def test_media_round_trip(spark):
    texts = [None, "", "a", "x" * 64, "é日" * 500, "same", "same", "long " * 50_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, digest string")
    got = {r.doc_id: r for r in media.store_and_read(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.width, r.height) == (64, len(payload) // 64)
    assert got[5].media_sha256 == got[6].media_sha256 and got[5].feature == got[6].feature and got[0].feature == got[1].feature


def test_shards_are_tar_files_with_each_payload_once(spark):
    root = fresh_path(spark, "t")
    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "doc_id bigint, text string").coalesce(1)
    index = media.write_shards(df, root).collect()
    (shard,) = {r.shard for r in index}
    path = f"{root.removeprefix('file:')}/{shard}"
    with tarfile.open(path) as tar, open(path, "rb") as f:
        assert sorted(tar.getnames()) == sorted({f"{r.digest}.png" for r in index}) and len(tar.getnames()) == 3
        f.seek(index[0].offset)
        assert f.read(index[0].length) == tar.extractfile(f"{index[0].digest}.png").read()
    meta = media.read_metadata(spark.createDataFrame(index), root).collect()
    assert {(r.width, r.bits) for r in meta} == {(64, 8)}


def test_damage_is_found():
    stored = bytearray(media.to_png(media.padded(b"abc" * 100)))
    assert media.from_png(bytes(stored)) == media.padded(b"abc" * 100)
    stored[60] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(stored))


def pages(spark):
    long = "<p>é日</p>" * 20_000  # over several segments, whose ends part characters
    html = [None, "", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, long, long, "\r\n\r\nWARC/1.1\r\n" * 100, "z" * 1000]
    rows = [(i, None if i == 4 else f"https://h.example/{i} a", h, 1) for i, h in enumerate(html)] + [(10, "https://again", "z" * 1000, 1), (None, "https://n", "y" * 1000, 1)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    got = warc.archive_and_read(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    best = {}
    for i, _, h, _ in rows:
        if h is not None and len(h.encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, -1), i)
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        response = best.get(h)
        want = ("response", None) if response is None or response == i else ("revisit", response)
        for r in by_id[i]:
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), *want)


def test_payloads_come_back(spark):
    rows, df = pages(spark)
    path = fresh_path(spark, "w")
    warc.write_archives(df.where("page_id IS NOT NULL"), path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    got = {r.page_id: r for r in warc.reassemble(warc.read_parts(spark, path)).collect()}
    assert bytes(got[8].payload).decode() == rows[8][2] and bytes(got[9].payload).decode() == rows[9][2]
    assert got[7].payload is None and got[7].refers_to == 8 and got[4].url == ""


def test_reader_takes_other_archives_and_finds_gaps(spark):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://a\r\n /b\r\nContent-Length: 47\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 8\r\n\r\nabcdefgh\r\n"
    got = list(warc.parse(io.BytesIO(b"\r\n" + record + b"\r\n\r\n")))
    assert got[0][0]["warc-target-uri"] == "http://a /b" and len(got[0][1]) == 47
    assert warc.unchunked(warc.chunked(b"a" * 20_000)) == b"a" * 20_000 and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(record[:-20])))
    parts = spark.createDataFrame([("r", 1, None, "response", 1, None, "", "", None, bytearray(b"x")), ("r", 3, 2, "continuation", None, None, "", "", None, bytearray(b"y"))], warc.PART)
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(parts).collect()
    assert gzip.decompress(gzip.compress(record)) == record


def test_empty_tables(spark):
    assert media.store_and_read(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert warc.archive_and_read(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert F is not None
