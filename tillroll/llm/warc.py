"""Dictionary-compressed WARC archives (operator 8).

Writer. Records with equal payloads (by SHA-256) of at least ``MIN_REVISIT``
bytes become one response, that of the smallest page id, and revisits that
refer to it; smaller ones are all responses. A Zstandard dictionary is trained
on a bounded sample of the records; every archive begins with a skippable
frame that holds it, and every record is a Zstandard frame of its own, so each
can be read alone. Files are written by Spark's text writer, one row per
frame: its line separator is an empty skippable frame, legal anywhere in a
Zstandard file. So any Hadoop store works, and a lost executor leaves no
half-written archive.

Reader. Finds the dictionary, walks the frames by their block headers,
decompresses record by record and verifies every payload digest.

Null html is an empty payload, a null url has no target line. Rows that repeat
the smallest id with the same payload are all responses. A null page id is
kept; it is never the smallest unless all are null. Extra columns are ignored.
An empty table writes no archive and reads back as no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_arrow, shared_path

MIN_REVISIT = 100
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 20   # most records, and bytes, a dictionary is trained on
MAX_SEGMENT = 16 << 10                      # bytes, at most, of each of the two parts of a long record
LEVEL = 3
WARC_DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"      # skippable frame that holds the dictionary
# An empty skippable frame (magic, size 0): what separates the records.
SEPARATOR = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. ``refers_to``: () for a response, else (page id,)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}",
             f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {WARC_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to[0]}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard or skippable frame that begins at ``at`` ends."""
    magic = struct.unpack_from("<I", data, at)[0]
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    head = bytes(data[at:at + 18])
    checksum = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    while True:
        h = int.from_bytes(data[at:at + 3], "little")
        at += 3 + (1 if (h >> 1) & 3 == 1 else h >> 3)      # a run-length block stores one byte
        if h & 1:
            return at + 4 * checksum


def train(records: list[bytes]) -> bytes:
    """A dictionary from sample records; their own bytes where there are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive."""
    view, at = memoryview(data), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        if view[at:at + 4] == DICTIONARY_MAGIC:
            held = bytes(view[at + 8:end])
            if held:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        elif struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 != 0x184D2A50:
            yield parse(reader.decompress(view[at:end]))
        at = end


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, url, payload, digest, revisits`` (null for a response).

    What a page becomes is decided on ids and digests alone (a payload that a
    third of all pages share costs one lean row each, and that join may be
    split); the payloads move once, by page, and are dealt to the archives by
    the same exchange.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    digest = F.sha2(payload, 256)
    lean = pages.select(F.col(id_col).alias("page_id"), digest.alias("digest"),
                        (F.octet_length(payload) >= MIN_REVISIT).alias("long"))
    firsts = (lean.where("long").groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.col("digest").alias("of"), "first"))
    decided = (lean.select("page_id", "digest").distinct().join(firsts, F.col("digest") == F.col("of"), "left")
               .select(F.col("page_id").alias("d_id"), F.col("digest").alias("d_digest"),
                       F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("revisits")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("payload"), digest.alias("digest"))
    return (rows.join(decided.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("d_id"))
                      & (F.col("digest") == F.col("d_digest")))
            .select("page_id", "url", "payload", "digest", "revisits"))


def dictionary(pages: DataFrame, url_col: str, html_col: str) -> bytes:
    """Trained on the SAMPLE_ROWS distinct payloads of the lowest hashes. Of a payload
    over its share of SAMPLE_BYTES, half of the share is its beginning and half a
    segment at a hashed place."""
    drawn = pages.where(F.col(html_col).isNotNull()).select(
        F.xxhash64(html_col, F.lit(11)).alias("h"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    lowest = drawn.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS)
    last, n = lowest.agg(F.max("h"), F.count(F.lit(1))).first()
    if not n:
        return b""
    half = min(MAX_SEGMENT, SAMPLE_BYTES // n // 2)
    body, size = F.encode("html", "utf-8"), F.octet_length("html")
    place = half + F.pmod(F.xxhash64("h"), F.greatest(size - 2 * half, F.lit(0)) + 1).cast("int")
    part = F.when(size <= 2 * half, body).otherwise(
        F.concat(F.substring(body, F.lit(1), F.lit(half)), F.substring(body, place + 1, F.lit(half))))
    # Equal payloads are one record, combined in each task before the shuffle.
    records = (drawn.where(F.col("h") <= last).groupBy("h")
               .agg(F.min(F.struct(F.coalesce("url", F.lit("")).alias("url"), part.alias("part"))).alias("r"))
               .select("h", "r.*").collect())
    return train([record(0, r["url"], bytes(r["part"]), hashlib.sha256(r["part"]).hexdigest(), ())
                  for r in sorted(records, key=lambda r: r["h"])])


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> None:
    """Writes ``out``/part-*: dictionary frame first, then one frame per record.

    Adaptive execution sizes the archives: one per partition of
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` payload bytes.
    """
    held = dictionary(pages, url_col, html_col)
    planned = plan_records(pages, id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(held) if held else None
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
        lead = DICTIONARY_MAGIC + struct.pack("<I", len(held)) + held
        for b in batches:
            out_rows = [lead] if lead else []
            lead = None
            for p, url, body, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                refers = () if first is None else (first,)
                out_rows.append(writer.compress(record(p, url, body, digest, refers)))
            yield pa.RecordBatch.from_arrays([pa.array(out_rows, pa.binary())], names=["frame"])

    (map_arrow(planned, run, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR.decode()).text(out))


def read_archives(spark, out: str) -> DataFrame:
    """One row per record of the archives in ``out``: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, payload`` (null for revisits)."""

    def number(urn: str) -> int | None:
        text = urn[len("<urn:page:"):-1]
        return None if text == "None" else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for f, body in read_archive(data.as_py()):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = f["WARC-Type"] == "response"
                    if response and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload digest of {f['WARC-Record-ID']}")
                    rows.append((number(f["WARC-Record-ID"]),
                                 len(body) if response else int(f["X-Payload-Length"]), digest, f["WARC-Type"],
                                 None if response else number(f["WARC-Refers-To"]),
                                 body if response else None))
                    size += len(body)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("content")
    return map_arrow(files, run, "page_id long, payload_bytes long, payload_digest string, "
                                 "record_type string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back."""
    out = out or shared_path(pages.sparkSession, "warc")
    write_archives(pages, out)
    return read_archives(pages.sparkSession, out)
