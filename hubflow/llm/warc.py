"""WARC archives: one gzip member per record, written and read sequentially.

Writing: every page becomes a record. Of pages with equal payloads of at least
``MIN_REVISIT_BYTES`` the one with the smallest id is a ``response``, the others
are ``revisit`` records that refer to it and carry no payload. Archives have a
bounded size; a task streams its records into a file of its own attempt and
renames that to its final name, so a repeated or lost attempt leaves no partial
archive behind under a listed name.

Reading: a file is read in chunks and inflated incrementally; at the end of a
member the next begins in the bytes left over. A record's block is framed by
Content-Length and its digests are verified. Archives of other writers are read
as well: header names in any case, records of every type, digests that are
absent, of SHA-1, SHA-256 or MD5, in base 32 or hexadecimal (others can't be
verified and are passed on), payloads with chunked transfer coding.

Defined cases: null html is an empty payload; a null url becomes
``urn:page:<id>``; records with equal payloads and equal smallest ids are all
responses; a null id never is the smallest (unless all are null: then all are
responses) and reads back as null; pages equal in id, url and payload share an
archive, which is streamed, never held; a payload may be longer than an
archive's size; an empty table writes no archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.sources.sinks import shared_dir

from .common import row_slices, staged, table

MIN_REVISIT_BYTES = 100
#: Payload bytes that go to one archive, about, and bytes read at a time.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
#: Digest algorithms that are verified, by the names that headers give them.
_HASHES = {"sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "md5": "md5"}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that isn't framed as its headers say, or fails its digests."""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = _HTTP % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else f'urn:page:{page_id}'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(read) -> Iterator[bytes]:
    """The content of each gzip member; ``read(n)`` gives the next bytes."""
    left = b""
    while left or (left := read(CHUNK)):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not left and not (left := read(CHUNK)):
                raise WarcError("the archive ends inside a record")
            parts.append(inflate.decompress(left))
            left = inflate.unused_data
        yield b"".join(parts)


def _agrees(stated: str | None, data: bytes) -> bool:
    """Whether a digest header (``algorithm:value``) fits; an absent one or one
    of an algorithm not known here does."""
    name, _, value = (stated or "").strip().partition(":")
    if name.lower() not in _HASHES:
        return True
    raw = hashlib.new(_HASHES[name.lower()], data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def records(read) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive,
    framed and verified."""
    for member in members(read):
        head, found, rest = member.partition(b"\r\n\r\n")
        lines = head.decode(errors="replace").split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise WarcError("not a WARC record")
        headers: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        named = headers.get("warc-record-id", "a record without id")
        n = int(headers["content-length"]) if headers.get("content-length", "").isdecimal() else -1
        if n < 0 or rest[n:] != b"\r\n\r\n":
            raise WarcError(f"{named}: the block isn't as long as its header says")
        block = rest[:n]
        if not _agrees(headers.get("warc-block-digest"), block):
            raise WarcError(f"{named}: wrong block digest")
        yield headers, block


def dechunked(body: bytes) -> bytes | None:
    """The content of a body with chunked transfer coding; None if it isn't one."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """The verified payload of a record, None for a revisit: what follows the
    HTTP headers of an HTTP message, the whole block of anything else."""
    if headers.get("warc-type") == "revisit":
        return None
    stated, payload = headers.get("warc-payload-digest"), block
    if headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if re.search(rb"(?im)^transfer-encoding:.*chunked", http):
            content = dechunked(payload)
            # writers differ in whether the digest is that of the coded body
            if content is not None and (_agrees(stated, content) or _agrees(stated, payload)):
                return content
    if not _agrees(stated, payload):
        raise WarcError(f"{headers.get('warc-record-id')}: wrong payload digest")
    return payload


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder``, which all
    executors share; the result lists them (path, n_records)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    sized = base.withColumn("n", F.octet_length("html"))
    total = sized.agg(F.sum(F.col("n").cast("long") + 512)).first()[0] or 0
    archives = max(1, math.ceil(total / archive_bytes))
    equal = sized.where(F.col("n") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c"))
    # a written table: the join sees its size, and can split a payload that
    # many pages share
    firsts = staged(equal.where("c > 1 and first_id is not null").select("digest", "first_id"))
    typed = base.join(firsts, "digest", "left").withColumn(
        "revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    )
    archive = F.pmod(F.xxhash64("page_id", "digest", "url"), F.lit(archives)).cast("int")
    dealt = typed.select(archive.alias("archive"), "page_id", "url", "html", "digest", "first_id", "revisit")
    # by number, not by its hash: one archive a task
    dealt = dealt.repartitionById(archives, F.col("archive")).sortWithinPartitions("archive", "page_id", "digest", "url")
    store, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(root)

    def write(batches):
        disk = fs.FileSystem.from_uri(folder)[0] if ":" in folder else fs.LocalFileSystem()
        now, out, n, attempt = None, None, 0, uuid.uuid4().hex
        done = []

        def close():
            out.close()
            disk.move(f"{root}/.{attempt}-{now}", f"{root}/pages-{now:06d}.warc.gz")
            done.append((f"{root}/pages-{now:06d}.warc.gz", n))

        for part in row_slices(batches, 64):
            for r in part.to_pylist():
                if r["archive"] != now:
                    if out:
                        close()
                    now, n = r["archive"], 0
                    out = disk.open_output_stream(f"{root}/.{attempt}-{now}", compression=None)
                out.write(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["first_id"], r["revisit"]))
                n += 1
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    return staged(dealt.mapInArrow(write, "path string, n_records long"))


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the listed archives: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to and payload (null for revisits,
    and if ``payloads`` is off). A task reads one archive at a time.

    Records of other writers have no page_id and refers_to. Their digest is that
    of the payload in hexadecimal SHA-256; for revisits the one stated, with its
    algorithm unless that is SHA-256, and no payload_bytes."""

    def read(batches):
        disk = fs.FileSystem.from_uri(folder)[0] if ":" in folder else fs.LocalFileSystem()
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def number(value):
            return int(value) if value is not None else None

        for part in batches:
            for path in part.column(0).to_pylist():
                rows, held = [], 0
                with disk.open_input_stream(path, compression=None) as stream:
                    for h, block in records(stream.read):
                        payload = payload_of(h, block)
                        if payload is None:
                            size, digest = number(h.get("x-payload-length")), h.get("warc-payload-digest")
                            digest = digest and digest.removeprefix("sha256:")
                        else:
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        pages = number(h.get("x-page-id")), number(h.get("x-refers-to-page"))
                        rows.append((pages[0], h.get("warc-target-uri"), h.get("warc-type"), size, digest, pages[1], payload if payloads else None))
                        held += len(block)
                        if len(rows) >= 1000 or held > CHUNK * 64:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    n = max(1, min(archives.count(), spark.sparkContext.defaultParallelism * 4))
    return archives.select("path").repartition(n).mapInArrow(read, schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, archives, folder, payloads=False).drop("payload", "url")


OP8_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN repeat THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN repeat THEN first_id END AS refers_to
FROM (
  SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS repeat
  FROM (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
    FROM pages))
"""
