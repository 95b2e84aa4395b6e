"""WARC archives in Zstandard: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record is one frame of its
own. Spark's text sink writes the frames: its line separator is set to an empty skippable frame, which decoders pass over,
so archives go to whatever store Spark writes to. The reader takes whole archives from Spark's binary source, so the writer
bounds them by bytes. It also reads what others have written: frames without a content size, all types of records, ids of
any form, and payload digests by SHA-256, SHA-1 or MD5, in base 16 or 32, or none.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import struct
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, shared_path

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records and bytes of an archive, at most (a record that is larger stands alone): bounds what a reading task holds.
RECORDS, ARCHIVE_BYTES = 4096, 64 << 20
#: What the dictionary of an archive is trained on, at most.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 4 << 20, 16 << 10
#: Payloads of fewer bytes never become revisits.
REVISIT_BYTES = 100


class ArchiveError(ValueError):
    pass


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None,
    date: str = "1970-01-01T00:00:00Z",
) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        safe = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
        lines.append(f"WARC-Target-URI: {safe}")
        if safe != url:
            lines.append(f"X-Target-As-Given: {json.dumps(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if kind != "revisit" else b""
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Headers that a record may have several of.
MANY = {"warc-concurrent-to", "warc-protocol", "set-cookie"}


def _headers(lines: list[bytes], what: str, strict: bool = True) -> dict[str, str]:
    """Names in lower case; lines that go on the one before are joined. Servers' own headers may be out of order."""
    found: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            if strict:
                raise ArchiveError(f"{what}: header line {line[:80]!r}")
            continue
        last = name.decode("ascii", "replace").lower()
        if last in found and strict and last not in MANY:
            raise ArchiveError(f"{what}: {last} twice")
        found[last] = value.strip().decode("utf-8", "replace")
    return found


def _length(headers: dict[str, str], what: str) -> int:
    n = headers.get("content-length", "")
    if not n.isascii() or not n.isdigit():
        raise ArchiveError(f"{what}: Content-Length {n!r}")
    return int(n)


def page_of(record_id: str | None) -> int | None:
    """The page that a record id of ours names."""
    inside = (record_id or "").strip("<>")
    return int(inside[9:]) if inside.startswith("urn:page:") and inside[9:].lstrip("-").isdigit() else None


def _digest(value: str | None) -> tuple[str, bytes] | None:
    """(algorithm, bytes) of a labelled digest in base 16 or 32; None for others."""
    name, _, text = (value or "").partition(":")
    name = name.lower().replace("-", "")
    size = {"sha256": 32, "sha1": 20, "md5": 16}.get(name)
    if size is None:
        return None
    try:
        if len(text) == 2 * size:
            return name, binascii.unhexlify(text)
        return name, base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except (binascii.Error, ValueError):
        return None


def parse(data: bytes, what: str = "record") -> dict:
    """The fields of one record; raises ArchiveError unless its headers and lengths, and a digest it gives, are in order.

    record_type is response, revisit, resource, warcinfo or whatever else the record says; the payload is the body of an
    HTTP response, or the whole block of records without HTTP headers. payload_bytes is that of the full payload, also where
    a revisit leaves it out; payload_digest is its SHA-256 in base 16, from the record where there is no payload to take it
    of (null if it gives another one).
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise ArchiveError(f"{what}: starts with {data[:16]!r}")
    h = _headers(lines[1:], what)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ArchiveError(f"{what}: no {name}")
    if len(rest) != _length(h, what) + 4 or rest[-4:] != b"\r\n\r\n":
        said = h["content-length"]
        raise ArchiveError(f"{what}: its block has {len(rest) - 4} bytes, Content-Length says {said}")
    block, kind, given = rest[:-4], h["warc-type"].lower(), _digest(h.get("warc-payload-digest"))
    payload, full = block, len(block)
    if kind in ("response", "request", "revisit") and h.get("content-type", "").lower().startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap and not (kind == "revisit" and not block):
            raise ArchiveError(f"{what}: no HTTP header")
        own = _headers(http.split(b"\r\n")[1:], what, strict=False)
        full = len(payload)
        if "transfer-encoding" not in own and "content-length" in own and kind != "request":
            full = _length(own, what)
            if kind == "response" and len(payload) != full:
                raise ArchiveError(f"{what}: the payload has {len(payload)} bytes, its header says {full}")
    if kind == "revisit":
        if payload or not (h.get("warc-refers-to") or h.get("warc-refers-to-target-uri")) or "warc-profile" not in h:
            raise ArchiveError(f"{what}: no sound revisit")
        payload, digest = None, given[1].hex() if given and given[0] == "sha256" else None
    else:
        digest = hashlib.sha256(payload).hexdigest()
        if given and getattr(hashlib, given[0])(payload).digest() != given[1]:
            raise ArchiveError(f"{what}: the payload doesn't have its digest")
    url = json.loads(h["x-target-as-given"]) if "x-target-as-given" in h else h.get("warc-target-uri")
    refers = h.get("warc-refers-to") if kind == "revisit" else None
    return {
        "page_id": page_of(h["warc-record-id"]), "record_id": h["warc-record-id"].strip("<>"), "url": url,
        "payload": payload, "payload_bytes": full, "payload_digest": digest, "record_type": kind,
        "refers_to": page_of(refers), "refers_to_id": refers.strip("<>") if refers else None,
    }


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; their own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _usable(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def archive_frames(
    records: Iterator[bytes], most: int = RECORDS, most_bytes: int = ARCHIVE_BYTES, fill: bool = False
) -> Iterator[bytes]:
    """The frames of one archive after the other: each a dictionary frame and then up to `most` records of up to most_bytes
    together. With fill, empty strings make up what an archive lacks of `most`, so that it is known where the next begins."""
    records, held = iter(records), None
    while True:
        first: list[bytes] = [] if held is None else [held]
        held, sampled = None, sum(map(len, first))
        while len(first) < min(SAMPLE_RECORDS, most) and sampled <= min(SAMPLE_BYTES, most_bytes):
            r = next(records, None)
            if r is None:
                break
            first.append(r)
            sampled += len(r)
        if not first:
            return
        words = dictionary([r[: SAMPLE_BYTES // SAMPLE_RECORDS] for r in first])
        yield struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words
        press = zstandard.ZstdCompressor(level=3, dict_data=_usable(words), write_checksum=True)
        count, size = 0, 0
        while count < most:
            r = first.pop(0) if first else next(records, None)
            if r is None:
                break
            frame = press.compress(r)
            if count and size + len(frame) > most_bytes:
                held = r
                break
            yield frame
            count, size = count + 1, size + len(frame)
        if held is not None and first:  # sampled records that no longer fit come first in the next archive
            records = chain([held, *first], records)
            held = None
        if fill:
            yield from [b""] * (most - count)


def _frame_end(data: memoryview, at: int, what: str) -> int:
    """Where the Zstandard frame that starts at `at` ends, from its header and block sizes."""
    try:
        head = bytes(data[at : at + 18])
        place = at + zstandard.frame_header_size(head)
        checksum = zstandard.get_frame_parameters(head).has_checksum
        while True:
            block = int.from_bytes(data[place : place + 3], "little")
            if place + 3 > len(data) or (block >> 1) & 3 == 3:
                raise ArchiveError(f"{what}: broken block at byte {place}")
            place += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
            if block & 1:
                break
    except zstandard.ZstdError as e:
        raise ArchiveError(f"{what}: {e}") from None
    place += 4 * checksum
    if place > len(data):
        raise ArchiveError(f"{what}: the frame at byte {at} is cut off")
    return place


def read_archive(data: bytes, what: str = "archive") -> Iterator[dict]:
    """The records of an archive: the dictionary from the leading skippable frame (itself compressed or not), then one
    record a frame. Frames need not tell their size."""
    view, at, words = memoryview(data), 0, None
    known = None
    while at < len(view):
        if at + 8 > len(view):
            raise ArchiveError(f"{what}: {len(view) - at} bytes after the last frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise ArchiveError(f"{what}: a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ArchiveError(f"{what}: a dictionary at byte {at}")
                words = bytes(view[8 : 8 + size])
                if words[:4] == struct.pack("<I", FRAME_MAGIC):
                    words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ArchiveError(f"{what}: no frame at byte {at}")
        known = known or zstandard.ZstdDecompressor(dict_data=_usable(words or b""))
        end = _frame_end(view, at, what)
        try:
            frame = known.decompressobj()
            whole = frame.decompress(view[at:end])
            if not frame.eof:
                raise ArchiveError(f"{what}: the frame at byte {at} does not end")
            yield parse(whole, f"{what}, byte {at}")
        except zstandard.ZstdError as e:
            raise ArchiveError(f"{what}, byte {at}: {e}") from None
        at = end


def with_revisits(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to): of equal payloads of at least REVISIT_BYTES, the smallest page_id is
    the response and the others revisit it."""
    payload = F.encode(F.coalesce(column(html), F.lit("")), "UTF-8").alias("payload")
    rows = pages.select(column(id_col).cast("long").alias("page_id"), column(url).alias("url"), payload)
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest")
    firsts = large.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(firsts.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind, to = F.when(revisit, "revisit").otherwise("response"), F.when(revisit, F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", kind.alias("kind"), to.alias("refers_to"))


def write_archives(
    records: DataFrame, path: str, most: int = RECORDS, most_bytes: int = ARCHIVE_BYTES, date: str | None = None
) -> None:
    """Writes with_revisits()'s rows to archives under path, one or more for each partition; date is that of the records,
    now if none is given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    names = ("page_id", "url", "payload", "digest", "kind", "refers_to")

    def run(batches) -> Iterator[pa.RecordBatch]:
        each = (record(*(row[n] for n in names), date) for b in batches for row in b.to_pylist())
        held, size = [], 0
        for frame in archive_frames(each, most, most_bytes, fill=True):
            held.append(frame)
            size += len(frame)
            if size > 4 << 20 or len(held) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    frames = records.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    writer = frames.write.option("lineSep", EMPTY_FRAME.decode("latin-1"))
    writer.option("maxRecordsPerFile", most + 1).text(path)


#: What a record is read as; page_id and refers_to are null for ids that aren't ours.
FIELDS = {
    "page_id": "long", "record_id": "string", "url": "string", "payload_bytes": "long", "payload_digest": "string",
    "record_type": "string", "refers_to": "long", "refers_to_id": "string", "payload": "binary",
}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS of every record of the archives under path; payload is null for revisits.

    An archive is one value of Spark's binary source, so it has 2 GB at most; write_archives() keeps below ARCHIVE_BYTES.
    """
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(k, kinds[v]) for k, v in FIELDS.items()])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for r in read_archive(data.as_py(), name):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every row of pages as a record to archives in the shared folder and returns what reading them gives.

    Null html is an empty payload, a null url stays null. Every row is a record: repeated rows of the smallest page_id of a
    group are all responses, a null page_id counts as larger than any other, and groups of nulls only are responses. An
    empty table gives no rows; other columns of pages are not read.
    """
    path = shared_path(pages.sparkSession, "warc")
    write_archives(with_revisits(pages), path)
    wanted = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return read_archives(pages.sparkSession, path).select(*wanted)


#: The same in DuckDB's SQL, without the archives.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
t AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM t"""
