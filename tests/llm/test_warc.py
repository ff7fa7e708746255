import base64
import hashlib
import io
import os
import uuid
import zlib

import pytest

from hubflow.llm import warc
from hubflow.llm.queries import LLM_QUERIES
from hubflow.sources.sinks import shared_dir

PAGES = "page_id long, url string, html string, digest int"


def round_trip(spark, rows, **kw):
    folder = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES), folder, **kw)
    return archives, warc.read_archives(spark, archives, folder).collect()


def test_query_matches_plain_reading(spark):
    src = {r.page_id: r.html.encode() for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = LLM_QUERIES["op8_warc"](spark, "/root/testdata/sf0.001").collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in src.items()}
    assert len(got) == len(src)


def test_revisits_nulls_and_small_payloads(spark):
    big, small = "é" * 60, "x" * 99
    rows = [(5, "http://a/b c", big, 1), (3, None, big, 1), (9, "u\r\nv", big, 1), (None, "u", big, 1), (7, "u", small, 1), (8, "u", small, 1), (10, "u", None, 1), (11, "u", "", 1), (3, None, big, 1)]
    archives, got = round_trip(spark, rows, archive_bytes=700)
    assert archives.count() > 1
    by = sorted(((r.page_id is None, r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in got)
    assert by == [
        ((False, 3), "response", None, 120, big),
        ((False, 3), "response", None, 120, big),
        ((False, 5), "revisit", 3, 120, None),
        ((False, 7), "response", None, 99, small),
        ((False, 8), "response", None, 99, small),
        ((False, 9), "revisit", 3, 120, None),
        ((False, 10), "response", None, 0, ""),
        ((False, 11), "response", None, 0, ""),
        ((True, 0), "revisit", 3, 120, None),
    ]
    assert all(r.payload_digest == hashlib.sha256({120: big, 99: small, 0: ""}[r.payload_bytes].encode()).hexdigest() for r in got)


def test_empty_table(spark):
    archives, got = round_trip(spark, [])
    assert archives.count() == 0 and got == []


def one(payload=b"p" * 500):
    return warc.record(1, "http://x/", payload, hashlib.sha256(payload).hexdigest(), None, False)


def test_one_member_per_record_read_in_small_chunks():
    data = io.BytesIO(one() + one(b"") + one(b"q" * 200_000))
    got = [warc.payload_of(h, b) for h, b in warc.records(lambda n: data.read(7))]
    assert got == [b"p" * 500, b"", b"q" * 200_000]
    d = zlib.decompressobj(31)
    d.decompress(one() + one())
    assert d.eof and d.unused_data == one()


def test_damage_is_found():
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(one()[:-5]).read))
    plain = zlib.decompress(one(), 31)
    for bad in (plain.replace(b"ppp", b"pqp", 1), plain[:-4], plain + b"x"):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(packer.compress(bad) + packer.flush()).read))


def foreign(kind, block, *headers):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(["WARC/1.0", f"warc-type: {kind}", *headers, f"CONTENT-LENGTH:{len(block)}"])
    return packer.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def test_archives_of_other_writers(spark):
    def sha1(b):
        return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()

    http = "Content-Type: application/http; msgtype=response"
    page, coded = b"<p>hello</p>", b"5\r\n<p>he\r\n7;x=1\r\nllo</p>\r\n0\r\n\r\n"
    plain = b"HTTP/1.1 200 OK\r\n\r\n" + page
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + coded
    archive = b"".join([
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("response", plain, http, f"WARC-Block-Digest: {sha1(plain)}", f"WARC-Payload-Digest: {sha1(page)}", "WARC-Target-URI: http://a/"),
        foreign("response", chunked, http, f"WARC-Payload-Digest: {sha1(page)}"),
        foreign("response", chunked, http, f"WARC-Payload-Digest: {sha1(coded)}"),
        foreign("response", plain, http, "WARC-Payload-Digest: blake3:abc"),
        foreign("revisit", b"", http, f"WARC-Payload-Digest: {sha1(page)}"),
        foreign("metadata", b""),
        one(page),
    ])
    folder = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    root = folder.removeprefix("file:")
    os.makedirs(root)
    with open(f"{root}/crawl.warc.gz", "wb") as f:
        f.write(archive)
    got = warc.read_archives(spark, spark.createDataFrame([(f"{root}/crawl.warc.gz", 8)], "path string, n_records long"), folder).collect()
    hexed = hashlib.sha256(page).hexdigest()
    assert [(r.record_type, r.payload_bytes, r.page_id) for r in got] == [
        ("warcinfo", 13, None), *[("response", len(page), None)] * 4, ("revisit", None, None), ("metadata", 0, None), ("response", len(page), 1)
    ]
    assert [r.payload_digest for r in got[1:5]] == [hexed] * 4 and got[5].payload_digest == sha1(page)
    for bad in (foreign("response", plain, http, f"WARC-Payload-Digest: {sha1(b'other')}"), foreign("metadata", b"x", f"WARC-Block-Digest: {sha1(b'y')}")):
        with pytest.raises(warc.WarcError):
            [warc.payload_of(h, b) for h, b in warc.records(io.BytesIO(bad).read)]
    assert warc.dechunked(b"zz") is None and warc.dechunked(b"5\r\nab") is None


def test_one_archive_a_task_and_long_payloads(spark):
    rows = [(i, f"http://x/{i}", f"page {i} " * 200, 1) for i in range(60)] + [(99, "u", "y" * 3_000_000, 1)] + [(None, None, "same" * 100, 1)] * 30
    archives, got = round_trip(spark, rows, archive_bytes=100_000)
    paths = archives.collect()
    assert len({p.path for p in paths}) == len(paths) and sum(p.n_records for p in paths) == len(rows) == len(got)
    assert {r.page_id: len(r.payload) for r in got if r.page_id == 99} == {99: 3_000_000}
    assert sum(r.page_id is None and r.record_type == "response" for r in got) == 30
