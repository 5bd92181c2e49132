"""Operator 9: WARC archives compressed with Zstandard, written and read back.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on its first records, or their bytes as
they are where they are too few to train on; every record is one frame, compressed with that dictionary. The reader loads the dictionary, decodes frame by frame,
and validates version line, mandatory headers, block length, end of record and digests; a damaged archive raises
ValueError with its name and offset.

Of records with equal payloads of at least 100 bytes, the one with the smallest page id holds the payload; the others
are revisit records that name it. Which record that is comes from a grouped aggregate over digests, so html is never
grouped by content.

Files are written by the tasks themselves through pyarrow.fs (file, hdfs, s3, gs) into the shared folder, under names
that no other attempt uses; each attempt returns what it wrote, and only the files of finished attempts are in the
manifest that the reader follows. Losing an executor leaves stray files that nobody reads.

Defined cases. Null html is an empty payload, null urls leave out the target header, control characters in urls are
percent-encoded. Null page ids are never the smallest unless a group has no other. Rows that repeat a page id and its
payload are all responses if that id is the smallest. An empty table writes no archive and returns no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialise, scratch_path, table

DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICT_BYTES = 16384
TRAIN_RECORDS = 256
TRAIN_BYTES = 2 << 20
ARCHIVE_BYTES = 32 << 20
LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    text = record.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, validated."""
    head, cut, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not cut or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header {line!r}")
        headers[name] = value.strip()
    if missing := [h for h in MANDATORY if h not in headers]:
        raise ValueError(f"missing headers {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its header says")
    block = rest[:-4]
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError("the block differs from its digest")
    return headers, block


def parse_http(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Payload length and, for responses, the validated payload of an HTTP block."""
    head, cut, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length: *(\d+)\r?$", head)
    if not cut or not length:
        raise ValueError("no HTTP header")
    if headers["WARC-Type"] == "revisit":
        if payload:
            raise ValueError("a revisit with a payload")
        return int(length[1]), None
    if len(payload) != int(length[1]):
        raise ValueError("the payload is not as long as its header says")
    if headers.get("WARC-Payload-Digest") != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError("the payload differs from its digest")
    return len(payload), payload


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for records; a few records are one as they are."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICT_BYTES])


class ArchiveWriter:
    """One archive: records wait until there are enough to train the dictionary, then each becomes a frame."""

    def __init__(self, sink) -> None:
        self.sink, self.waiting, self.compressor = sink, [], None
        self.records = self.plain_bytes = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        self.plain_bytes += len(record)
        if self.compressor is None:
            self.waiting.append(record)
            if len(self.waiting) >= TRAIN_RECORDS or self.plain_bytes >= TRAIN_BYTES:
                self._begin()
        else:
            self.sink.write(self.compressor.compress(record))

    def _begin(self) -> None:
        d = train(self.waiting)
        content = d.as_bytes()
        self.sink.write(DICT_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True)
        for record in self.waiting:
            self.sink.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None and self.waiting:
            self._begin()
        self.sink.close()


def read_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame after the dictionary frame."""
    view, at, d = memoryview(data), 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == DICT_MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        if at > len(data):
            raise ValueError("the dictionary frame is cut short")
        content = bytes(view[8:at])
        if content[:4] == ZSTD_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        d = zstandard.ZstdCompressionDict(content)
    decoder = zstandard.ZstdDecompressor(dict_data=d)
    while at < len(data):
        begun, out, frame = at, [], decoder.decompressobj()
        while not frame.eof:
            if at >= len(data):
                raise ValueError(f"the frame at {begun} is cut short")
            step = view[at : at + (1 << 16)]
            try:
                out.append(frame.decompress(step))
            except zstandard.ZstdError as e:
                raise ValueError(f"the frame at {begun} is damaged") from e
            at += len(step) - len(frame.unused_data)
        yield begun, b"".join(out)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first) for every page that repeats the payload of another."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    rows = materialise(rows.where(F.col("n") >= LEAST_REVISIT).select("page_id", "digest"), "payloads")
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    return join_hot(rows, firsts, "digest", F.col("page_id")).where("first is not null and not page_id <=> first").distinct()


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write one record per page; the folder and its manifest (name, records)."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).alias("p")
    again = revisits(pages).alias("r")
    rows = rows.join(again, F.expr("p.page_id <=> r.page_id and p.digest = r.digest"), "left").select("p.page_id", "url", "html", "p.digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        writer, name, done = None, "", []
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
                writer.add(build_record(page_id.as_py(), url.as_py(), html.as_py().encode(), first.as_py(), digest.as_py()))
                if writer.plain_bytes >= archive_bytes:
                    writer.close()
                    done.append((name, writer.records))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((name, writer.records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["name", "records"])

    return folder, materialise(rows.mapInArrow(run, "name string, records long"), "manifest")


RECORD = "archive string, offset long, record_type string, record string, refers_to string, uri string, digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of the archives in a folder (of those in the manifest, if there is one), validated."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if manifest is not None:
        files = files.join(manifest.select("name"), "name", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                rows, held, at = [], 0, -1
                try:
                    for at, raw in read_frames(content.as_py()):
                        h, block = parse_record(raw)
                        n, payload = parse_http(h, block)
                        rows.append((name.as_py(), at, h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Payload-Digest", "").removeprefix("sha256:"), n, payload if payloads else None))
                        held += len(payload or b"") if payloads else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                except ValueError as e:
                    raise ValueError(f"{name}, after offset {at}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_archives(table(spark, sf_dir, "pages"))
    if not manifest.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(-?\d*)>$", 1), F.lit("")).cast("long")
    records = read_archives(spark, folder, manifest, payloads=False)
    return records.select(number("record").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


SQL = {
    "op9_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.payload_bytes >= 100 AND f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.payload_bytes >= 100 AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
}
