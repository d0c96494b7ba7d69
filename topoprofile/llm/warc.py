"""WARC archives as seekable Zstandard bundles.

Pages become WARC 1.1 records. Of records with equal payloads of at least
``min_bytes`` bytes the one with the largest page id is a response, the others
are revisits that refer to it; smaller payloads are all responses.

A bundle is a series of independent Zstandard frames of about ``FRAME`` bytes of
records, and a skippable frame at the end: the seek table of the Zstandard
seekable format (compressed and plain size of each frame). The index maps every
record to its bundle, frame and the offset inside that frame, so one record costs
one frame's decompression.

Defined cases. Null html: empty payload. Null page id: sorts below all ids;
written as an empty name and read back as null. Null url: no target. Rows that
repeat a page id and payload are one record's copies: all with the largest id are
responses. Empty table: no bundle. Payloads of any size are written whole, in a
frame of their own if larger than a frame. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import chain

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoprofile.llm.files import attempt_name, opened, small_batches, written
from topoprofile.llm.joins import join_lookup
from topoprofile.runtime import materialize, new_path

FRAME = 1 << 20
LEVEL = 3
#: Most tasks that read archives back.
TASKS = 10_000
DATE = "2026-01-01T00:00:00Z"
#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "page_id long, bundle string, frame long, offset long, length long"


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to, revisit``: decided per payload digest.

    Digests are counted with a map-side combine; only those that occur twice come
    back to the pages, hot ones by broadcast (see ``join_lookup``), so the html
    crosses the network once and no payload's copies meet in one task.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("_digest"))
    sizes = keyed.select("page_id", "_digest", F.octet_length("html").alias("size"))
    groups = sizes.where(F.col("size") >= min_bytes).groupBy("_digest").agg(F.count("*").alias("count"), F.max("page_id").alias("first"))
    groups = materialize(groups.where("count > 1"), "payloads")
    # equal payloads are rare: with none at all there is nothing to join
    if groups.isEmpty():
        joined = keyed.withColumn("first", F.lit(None).cast("long"))
    else:
        joined = join_lookup(keyed, groups.select("_digest", "first"), "_digest", groups.select("_digest", "count"), pages.count())
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def record_bytes(page_id, url, html: str, refers_to, revisit: bool) -> bytes:
    """One WARC record, header to trailing blank lines."""
    payload = html.encode("utf-8")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:  # header lines end at a line break
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        block += b"\r\n"
    else:
        block += f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at an offset of a plain frame."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("utf-8").split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = stop + 4
    end = start + int(head["Content-Length"])
    if lines[0] != "WARC/1.1" or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return head, data[data.index(b"\r\n\r\n", start, end) + 4 : end], end + 4


class BundleWriter:
    """Groups records into frames, and ends the bundle with its seek table."""

    def __init__(self, out):
        self.out, self.sizes, self.held, self.bytes = out, [], [], 0
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and frame-relative offset of the record."""
        if self.held and self.bytes + len(record) > FRAME:
            self.flush()
        place = len(self.sizes), self.bytes
        self.held.append(record)
        self.bytes += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.codec.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.bytes))
            self.held, self.bytes = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame of an open bundle."""
    size = source.size()
    source.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    source.seek(size - 9 - 8 * frames)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", source.read(8 * frames)):
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index: a single frame is read and expanded."""
    with opened(bundle) as source:
        at, packed, plain = read_seek_table(source)[frame]
        source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)
    return parse_record(data, offset)[:2]


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a bundle per task below ``folder``; the index, written and read back."""

    small_batches(pages.sparkSession)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/{attempt_name()}.warc.zst"
        none = lambda v: None if pd.isna(v) else v
        first = next((f for f in frames if len(f)), None)
        if first is None:
            return
        with written(path) as out:
            bundle = BundleWriter(out)
            for frame in chain([first], frames):
                rows = []
                for row in frame.astype({"page_id": "Int64", "refers_to": "Int64"}).itertuples(index=False):
                    record = record_bytes(none(row.page_id), none(row.url), row.html, none(row.refers_to), row.revisit)
                    rows.append((none(row.page_id), path, *bundle.add(record), len(record)))
                # the index counts only once the task, and so the bundle, is complete
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")]).astype({"page_id": "Int64"})
            bundle.close()

    return materialize(with_roles(pages, min_bytes).mapInPandas(write, INDEX_SCHEMA), "warc-index")


class FrameReader:
    """Plain frames by bundle and number; the open bundle, its seek table and its last frame are kept."""

    def __init__(self):
        self.expand = zstandard.ZstdDecompressor()
        self.bundle = self.held = self.close = None

    def frame(self, bundle: str, number: int) -> bytes:
        if bundle != self.bundle:
            self.stop()
            self.close = ExitStack()
            self.source = self.close.enter_context(opened(bundle))
            self.bundle, self.table = bundle, read_seek_table(self.source)
        if number != self.held:
            at, packed, plain = self.table[number]
            self.source.seek(at)
            self.data, self.held = self.expand.decompress(self.source.read(packed), max_output_size=plain), number
        return self.data

    def stop(self) -> None:
        if self.close:
            self.close.close()
        self.bundle = self.held = self.close = None


def read_bundles(index: DataFrame) -> DataFrame:
    """Every indexed record, read at its bundle, frame and offset.

    Index rows are dealt by ranges of (bundle, frame), so a task opens few bundles
    and expands each of its frames once; no page crosses the network. A record that
    is not the one its index row names, or ends elsewhere, is an error.
    """
    bundles = index.select("bundle").distinct().count()
    dealt = index.repartitionByRange(max(1, min(bundles, TASKS)), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None
        reader = FrameReader()
        try:
            for frame in frames:
                rows = []
                for row in frame.astype({"page_id": "Int64"}).itertuples(index=False):
                    head, payload, stop = parse_record(reader.frame(row.bundle, row.frame), row.offset)
                    page = number(head["WARC-Record-ID"])
                    if stop - row.offset != row.length or page != (None if pd.isna(row.page_id) else row.page_id):
                        raise ValueError("the index names another record")
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError("a payload does not match its digest")
                    size = int(head["X-Payload-Length"]) if revisit else len(payload)
                    rows.append((page, size, digest, head["WARC-Type"], number(head["WARC-Refers-To"]) if revisit else None))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            reader.stop()

    return dealt.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, archived and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_bundles(write_bundles(pages, new_path(spark, "warc")))


_PAYLOAD = "coalesce(html, '')"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The archive read back, as the plain definition over pages: five hex digits of the SHA-1 are four base-32 digits.
ORACLE = f"""
WITH digests AS (SELECT page_id, CAST(strlen({_PAYLOAD}) AS BIGINT) AS payload_bytes, sha1({_PAYLOAD}) AS hex FROM pages),
keyed AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM digests)
SELECT page_id, payload_bytes,
       list_aggregate([substr('{_BASE32}',
           CAST(((('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1) for k in range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM keyed"""
