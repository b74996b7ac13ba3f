"""Token ids as binary files: static range asymmetric numeral system (operator 9).

Every text is encoded by the tokenizers library, an end id is appended, and
the ids go in ascending document order into files of independent blocks:

* one frequency table, counted over the ids of all documents, serves every
  block (ids that never occur get no code space);
* a block holds ``LANES`` interleaved rANS streams, id i belongs to lane
  i mod LANES, so numpy steps all lanes at once;
* checkpoints record the lane states and word positions every
  ``CHECKPOINT_STEPS`` steps, so parts of a block decode without the rest;
* CRC-32 over the ids and over the stored bytes is verified on reading.

Files are written by Spark's text writer, one row per block frame; its line
separator is the frame format's own end mark. So any Hadoop store works, and
the commit protocol leaves no half-written file after a lost executor. A
manifest (one row per file) turns local positions into global ones.

Null and empty texts consist of the end id. Documents with the same id follow
one another in the order of their text hash; null ids come first. Extra columns
are ignored. An empty table writes no frames and reads back as no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import batches_of, map_arrow, shared_path, stage, text_or_empty
from tillroll.llm.tokens import default_tokenizer, encoder

END_ID = 1
SCALE_BITS = 20             # frequencies sum to 2^20, above any vocabulary here
LANES = 1024
CHECKPOINT_STEPS = 64
BLOCK_IDS = 1 << 19         # ids a block closes at (a longer document makes a longer block)
ROWS = 1024                 # documents a worker is handed at once
MAGIC = b"RANB"
# Ends every frame; the text writer appends it to each row.
FRAME_END = b"\x1eEND\x1e\n"
FILE_BYTES = 16 << 20       # ids (before coding) a file is sized for, while
MAX_FILES = 100_000         # there are no more files than this
LOW = np.uint64(1 << 31)    # lane states lie in [2^31, 2^63)


class FrequencyTable:
    """Frequencies of all ids scaled to 2^SCALE_BITS; an id that occurs keeps
    at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> "FrequencyTable":
        total, size = int(counts.sum()), 1 << SCALE_BITS
        used = np.flatnonzero(counts)
        freq = np.zeros(len(counts), np.int64)
        if len(used):
            share = counts[used].astype(object) * (size - len(used)) // total
            freq[used] = 1 + share.astype(np.int64)
            freq[used[np.argmax(counts[used])]] += size - int(freq.sum())
        return cls(freq)


def encode_block(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """One block: header, checkpoints, 32-bit words. Lanes run from the last id
    to the first, so that decoding runs forwards."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words, marks = [], []
    shift = np.uint64(SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        part = ids[step * LANES:(step + 1) * LANES]
        k = len(part)
        f, s = table.freq[part], table.start[part]
        x = state[:k]
        over = x >= (f << np.uint64(63 - SCALE_BITS))
        words.append(x[over].astype(np.uint32))
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[:k] = (q << shift) + (x - q * f) + s
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((step, state.copy()))
    counts = np.array([len(w) for w in words[::-1]], np.int64)
    ends = np.concatenate(([0], np.cumsum(counts)))
    body = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    points = b"".join(struct.pack("<II", step, int(ends[step])) + st.astype("<u8").tobytes()
                      for step, st in reversed(marks))
    head = struct.pack("<IIII", n, len(marks), len(body) // 4, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + state.astype("<u8").tobytes() + points + body


def decode_steps(state: np.ndarray, words: np.ndarray, n: int, table: FrequencyTable) -> np.ndarray:
    """``n`` ids from lane states and the words that follow them."""
    out, at = np.empty(n, np.uint32), 0
    mask, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    state = state.copy()
    for lo in range(0, n, LANES):
        k = min(LANES, n - lo)
        x = state[:k]
        low = x & mask
        sym = table.slot[low.astype(np.int64)]
        out[lo:lo + k] = sym
        x = table.freq[sym] * (x >> shift) + low - table.start[sym]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << np.uint64(32)) | words[at:at + len(need)].astype(np.uint64)
            at += len(need)
        state[:k] = x
    return out


def read_block(data: bytes, table: FrequencyTable, first_step: int = 0) -> np.ndarray:
    """The ids of a block from a checkpoint on (``first_step`` 0: all of it,
    with the checksum verified)."""
    n, marks, size, crc = struct.unpack_from("<IIII", data)
    at, state, skip = 16, None, 0
    state = np.frombuffer(data, "<u8", LANES, at).astype(np.uint64)
    at += 8 * LANES
    for _ in range(marks):
        step, pos = struct.unpack_from("<II", data, at)
        if step == first_step:
            state, skip = np.frombuffer(data, "<u8", LANES, at + 8).astype(np.uint64), pos
        at += 8 + 8 * LANES
    words = np.frombuffer(data, "<u4", size, at)[skip:]
    ids = decode_steps(state, words, n - first_step * LANES, table)
    if not first_step and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("ids do not match the block's checksum")
    return ids


def frame(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, table: FrequencyTable) -> bytes:
    """A stored block: magic, sizes, document directory, block, CRC-32."""
    directory = json.dumps([doc_ids, lengths.tolist()], separators=(",", ":")).encode()
    directory = zlib.compress(directory, 6)
    block = encode_block(ids, table)
    body = struct.pack("<II", len(directory), len(block)) + directory + block
    return MAGIC + body + struct.pack("<I", zlib.crc32(body))


def frames(data: bytes) -> Iterator[tuple[list, list, bytes]]:
    """Document ids, lengths and block bytes of every frame of a file."""
    at = 0
    while at < len(data):
        if data[at:at + 4] != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        a, b = struct.unpack_from("<II", data, at + 4)
        body = data[at + 4:at + 12 + a + b]
        at += 12 + a + b
        if struct.unpack_from("<I", data, at)[0] != zlib.crc32(body) or \
                data[at + 4:at + 4 + len(FRAME_END)] != FRAME_END:
            raise ValueError("frame checksum")
        at += 4 + len(FRAME_END)
        doc_ids, lengths = json.loads(zlib.decompress(body[8:8 + a]))
        yield doc_ids, lengths, body[8 + a:]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with ``end_id`` behind each text's, and the new ends."""
    ends = ends + np.arange(len(ends))
    out, is_id = np.empty(ends[-1], kind), np.ones(ends[-1], bool)
    is_id[ends[1:] - 1] = False
    out[is_id], out[~is_id] = ids, end_id
    return out, ends


def cut(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, one after another in the memory of ``ids``."""
    offsets = pa.array(ends * ids.itemsize, pa.int32())     # fails where they do not fit
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets.buffers()[1], pa.py_buffer(ids)])


def joined(values: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``cut`` was given, without a copy of the ids."""
    values = values.cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    size = np.dtype(kind).itemsize
    if ends[-1] == ends[0]:
        return np.zeros(0, kind), np.zeros(len(values) + 1, np.int64)
    ids = np.frombuffer(values.buffers()[2], kind, (ends[-1] - ends[0]) // size, ends[0])
    return ids, (ends - ends[0]) // size


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID) -> DataFrame:
    """``(doc_id, text_hash, ids)``; ids are little-endian uint16 or uint32
    (as the vocabulary needs), the end id last."""
    text = text_or_empty(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        kind = "<u2" if len(coder.word_end) <= 1 << 16 else "<u4"
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                ids, ends = with_end(*coder.encode(b.column(2)), end_id, kind)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cut(ids, ends)],
                                                 names=["doc_id", "text_hash", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text"))
    return map_arrow(rows, run, "doc_id long, text_hash long, ids binary")


def id_kind(path: str) -> str:
    return "<u2" if len(encoder(path).word_end) <= 1 << 16 else "<u4"


def count_ids(encoded: DataFrame, kind: str, size: int) -> np.ndarray:
    """Occurrences of each id over all rows (one row per id at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                total += np.bincount(joined(b.column(0).slice(lo, ROWS), kind)[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])],
                                         names=["id", "n"])

    rows = map_arrow(encoded.select("ids"), run, "id int, n long").groupBy("id").agg(
        F.sum("n").alias("n")).collect()        # as many rows as the vocabulary has ids
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_files(encoded: DataFrame, out: str, freq: np.ndarray, kind: str, files: int) -> None:
    """Blocks in ascending document order, range-dealt over ``files`` files."""
    spark = encoded.sparkSession
    table_bytes = spark.sparkContext.broadcast(freq)    # one number per vocabulary id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(table_bytes.value)
        doc_ids, lengths, parts, held = [], [], [], 0

        def flush():
            data = frame(doc_ids, np.concatenate(lengths), np.concatenate(parts), table)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["frame"])

        for b in batches:
            ids, ends = joined(b.column(1), kind)
            at = 0
            while at < b.num_rows:
                # Up to the document that fills the block.
                to = min(b.num_rows, int(np.searchsorted(ends, ends[at] + BLOCK_IDS - held)))
                doc_ids += b.column(0).slice(at, to - at).to_pylist()
                lengths.append(np.diff(ends[at:to + 1]))
                parts.append(ids[ends[at]:ends[to]].astype(np.uint32))
                held += int(ends[to] - ends[at])
                at = to
                if held >= BLOCK_IDS:
                    yield flush()
                    doc_ids, lengths, parts, held = [], [], [], 0
        if parts:
            yield flush()

    dealt = (encoded.repartitionByRange(files, F.col("doc_id"), F.col("text_hash"))
             .sortWithinPartitions("doc_id", "text_hash").select("doc_id", "ids"))
    (map_arrow(dealt, run, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", FRAME_END.decode()).text(out))


def read_files(spark, out: str, freq: np.ndarray) -> DataFrame:
    """``(file, seq, doc_id, local_start, ids)`` of every document, from the files."""
    table_bytes = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(table_bytes.value)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seq = at = 0
                for doc_ids, lengths, block in frames(data.as_py()):
                    ids = read_block(block, table).astype("<u4")
                    ends, n = np.concatenate(([0], np.cumsum(lengths))), len(lengths)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n, pa.int64()), pa.array(np.arange(seq, seq + n)),
                         pa.array(doc_ids, pa.int64()), pa.array(at + ends[:-1]), cut(ids, ends)],
                        names=["file", "seq", "doc_id", "local_start", "ids"])
                    seq, at = seq + n, at + len(ids)

    return map_arrow(_stored(spark, out), run, "file long, seq long, doc_id long, local_start long, ids binary")


def _stored(spark, out: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
            .select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), "content"))


def manifest(spark, out: str) -> DataFrame:
    """``(file, held)``: the ids each file holds, from its directories alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [sum(sum(lengths) for _, lengths, _ in frames(x.as_py())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.int64())],
                                             names=["file", "held"])

    return map_arrow(_stored(spark, out), run, "file long, held long")


def token_files(docs: DataFrame, path: str | None = None, out: str | None = None,
                id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files of ``docs`` to ``out`` and read them back.

    Returns ``doc_id, start, n_tokens, ids`` per row: ``start`` counts the ids
    of all documents before it.
    """
    spark = docs.sparkSession
    path = path or default_tokenizer()
    out = out or shared_path(spark, "tokens")
    kind = id_kind(path)
    size = len(encoder(path).word_end)
    with batches_of(spark, ROWS):
        encoded = stage(encode_texts(docs, path, id_col, text_col), "token-ids")
        counts = count_ids(encoded, kind, size)
    if not counts.any():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    freq = FrequencyTable.from_counts(counts).freq.astype(np.int64)
    files = min(MAX_FILES, max(1, -(-int(counts.sum()) * np.dtype(kind).itemsize // file_bytes)))
    with batches_of(spark, ROWS):
        write_files(encoded, out, freq, kind, files)
    back = read_files(spark, out, freq)
    # One row per file, MAX_FILES at most: small enough to sum up and broadcast.
    before = F.coalesce(F.sum("held").over(Window.orderBy("file").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = manifest(spark, out).select(F.col("file").alias("of"), before.alias("offset"))
    return (back.join(F.broadcast(offsets), F.col("file") == F.col("of"))
            .select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"),
                    (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"))
