"""BPE encoding with content-defined chunk reuse, and decoding (operator 10).

Encoding. A rolling hash over the last ``WINDOW`` code points cuts each text
where its low bits vanish, so equal passages are cut alike in every document.
Documents are dealt by the smallest of their chunk hashes (salted, so that a
third of all rows with one hash still spreads), which brings documents that
share chunks to one task; there each distinct chunk is encoded once and reused
from a bounded table. A cut may fall inside a word, so every join is repaired:
the last pieces before it and the first after it are encoded again as one
string, and the window grows, piece by piece, until the new ids begin with the
left chunk's own ids of the first piece and end with the right chunk's ids of
the last piece. Windows begin and end at white space, which the tokenizer
never joins across, so agreement there means the ids of the whole text.

Decoding joins the token strings with blanks, as the library's decode does for
a tokenizer without a decoder, specials included.

Null and empty texts have no ids. Repeated ids or rows keep one result row
each; null ids stay null. Very long texts are cut like any other, in linear
time. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_arrow, text_or_empty
from tillroll.llm.tokens import default_tokenizer, encoder, vocabulary_strings

WINDOW = 32                 # code points the rolling hash looks back
MEAN_BITS = 10              # a cut on average every 2^10 code points
MIN_CHUNK, MAX_CHUNK = 256, 8192
SALTS = 32                  # tasks over which one chunk hash may spread
REUSE_BYTES = 24 << 20      # ids a worker keeps for reuse
WORD_BYTES = 96 << 20       # what its encoder remembers of single pieces besides
SPACE = " \t\n\r\x0b\x0c"
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(_MULTIPLIER, 1 << 14)
_INVERSES = _powers(_INVERSE, 1 << 14)


def _rolling(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of the WINDOW code points that end at each position, in
    blocks so that the powers stay a fixed table."""
    out = np.zeros(len(points), np.uint64)
    block = len(_POWERS) - WINDOW
    for at in range(0, len(points), block):
        lo = max(0, at - WINDOW)
        part = points[lo:at + block]
        sums = np.cumsum(part * _POWERS[:len(part)], dtype=np.uint64)
        wide = sums.copy()
        wide[WINDOW:] -= sums[:-WINDOW]
        wide *= _INVERSES[:len(part)]
        out[at:at + block] = wide[at - lo:]
    return out


def cut_points(text: str) -> list[int]:
    """Ends of the chunks of ``text``, in code points."""
    n = len(text)
    if n <= MIN_CHUNK:
        return [n] if n else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    marks = np.flatnonzero((_rolling(points) >> np.uint64(40)) & np.uint64((1 << MEAN_BITS) - 1) == 0)
    ends, last = [], 0
    for m in (marks + 1).tolist():
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK:
            ends.append(m)
            last = m
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(text: str) -> list[str]:
    ends = cut_points(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class ChunkCoder:
    """Encodes chunk lists; remembers the ids of chunks by their 128-bit hash."""

    def __init__(self, path: str):
        self.encoder = encoder(path, WORD_BYTES)
        self.seen: dict[bytes, bytes] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encoder.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, docs: list[list[str]]) -> list[bytes]:
        """The ids (little-endian uint32) of texts given as their chunks."""
        keys = [[xxhash.xxh3_128_digest(c.encode("utf-8", "surrogatepass")) for c in d] for d in docs]
        if self.held > REUSE_BYTES:
            self.seen.clear()
            self.held = 0
        fresh = {}
        for ks, d in zip(keys, docs, strict=True):
            for k, c in zip(ks, d, strict=True):
                if k in self.seen:
                    self.reused += 1
                else:
                    fresh.setdefault(k, c)
        table = self.seen
        for k, ids in zip(fresh, self._ids(list(fresh.values())), strict=True):
            table[k] = ids
            self.held += len(ids) + 120
        self.encoded += len(fresh)
        return [self._joined(d, [table[k] for k in ks]) for ks, d in zip(keys, docs, strict=True)]

    def _pieces(self, words: list[str]) -> list[bytes]:
        return self.encoder.pieces(words) if words else []

    def _joined(self, texts: list[str], ids: list[bytes]) -> bytes:
        """Ids of the concatenated chunks: joins them from the left, repairing each."""
        if len(texts) < 2:
            return ids[0] if ids else b""
        out, left = [ids[0]], texts[0]      # out[-1] holds the ids of ``left``
        for right, right_ids in zip(texts[1:], ids[1:], strict=True):
            if left[-1] not in SPACE and right[0] not in SPACE:
                repaired = self._repair(left, out[-1], right, right_ids)
                if repaired is None:        # no white space to agree on: one longer chunk
                    left += right
                    out[-1] = self._ids([left])[0]
                    continue
                out[-1], right, right_ids = repaired
            out.append(right_ids)
            left = right
        return b"".join(out)

    def _repair(self, left: str, left_ids: bytes, right: str, right_ids: bytes):
        """``(ids of left with the joined word, rest of right, its ids)``, or
        None where either side has no white space to agree on."""
        size = 2
        while True:
            before, after = _last_pieces(left, size), _first_pieces(right, size)
            if len(before) < 2 or len(after) < 2:
                return None
            joined = before[-1] + after[0]
            new = self._ids([" ".join([*before[:-1], joined, *after[1:]])])[0]
            old_left, old_right = self.encoder.pieces(before), self.encoder.pieces(after)
            lead, trail = b"".join(old_left[:-1]), b"".join(old_right[1:])
            if (left_ids.endswith(lead + old_left[-1]) and right_ids.startswith(old_right[0] + trail)
                    and len(new) >= len(lead) + len(trail)
                    and new.startswith(lead) and new.endswith(trail)):
                word = new[len(lead):len(new) - len(trail)]
                return (left_ids[:len(left_ids) - len(old_left[-1])] + word,
                        right[len(after[0]):], right_ids[len(old_right[0]):])
            if len(before) < size and len(after) < size:
                return None
            size *= 2


def _last_pieces(text: str, n: int) -> list[str]:
    cut = text[-64 * n:]
    got = cut.encode("utf-8", "surrogatepass").split()
    if len(got) <= n and len(cut) < len(text):
        got = text.encode("utf-8", "surrogatepass").split()
    return [x.decode("utf-8", "surrogatepass") for x in got[-n:]]


def _first_pieces(text: str, n: int) -> list[str]:
    cut = text[:64 * n]
    got = cut.encode("utf-8", "surrogatepass").split()
    if len(got) <= n and len(cut) < len(text):
        got = text.encode("utf-8", "surrogatepass").split()
    return [x.decode("utf-8", "surrogatepass") for x in got[:n]]


def deal_by_chunk(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, body)`` dealt so that texts with a common smallest chunk hash meet."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [min((xxhash.xxh3_64_intdigest(c.encode("utf-8", "surrogatepass")) for c in chunks(t)),
                       default=0) >> 1 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.int64())],
                                             names=["doc_id", "body", "low"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"))
    kind = dict(rows.dtypes)["doc_id"]
    marked = map_arrow(rows, mark, f"doc_id {kind}, body string, low long")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marked.repartition(parts, "low", salt)


def _rows(docs: DataFrame, path: str | None, id_col: str, text_col: str, finish, extra: str) -> DataFrame:
    """Encodes the dealt rows; ``finish(path)`` makes from a slice's ids the columns
    ``extra`` declares. One Python worker per task does all of it."""
    path = path or default_tokenizer()
    dealt = deal_by_chunk(docs, id_col, text_col)
    names = ["doc_id", *(x.split()[0] for x in extra.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, columns = ChunkCoder(path), finish(path)
        for b in batches:
            order = pc.sort_indices(b.column(2))    # documents that share chunks side by side
            for at in range(0, len(order), 256):
                part = b.take(order.slice(at, 256))
                ids = coder.encode([chunks(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(ids)], names=names)

    kind = dict(dealt.dtypes)["doc_id"]
    return map_arrow(dealt, run, f"doc_id {kind}, {extra}")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` per row; ``ids``: little-endian unsigned 32-bit integers."""
    return _rows(docs, path, id_col, text_col, lambda p: lambda ids: [pa.array(ids, pa.binary())], "ids binary")


_STRINGS: dict[str, pa.Array] = {}


def _decoder(path: str):
    """Joins the token strings of each row's ids; the vocabulary is read once a worker."""
    if path not in _STRINGS:
        _STRINGS[path] = vocabulary_strings(path)
    strings = _STRINGS[path]

    def texts(raw: list[bytes]) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
        flat = strings.take(pa.array(np.frombuffer(b"".join(raw), "<u4")))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), " ")

    return texts


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with a column ``ids``) plus ``decoded``."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _decoder(path)
        for b in batches:
            at = b.schema.get_field_index("ids")
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, texts(part.column(at).to_pylist())],
                                                 names=[*b.schema.names, "decoded"])

    fields = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return map_arrow(encoded, run, f"{fields}, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: encoded and decoded again by the same worker, so
    that a task holds one tokenizer."""
    def finish(p):
        texts = _decoder(p)
        return lambda ids: [pa.array(ids, pa.binary()), texts(ids)]

    return _rows(docs, path, id_col, text_col, finish, "ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    both = round_trip(docs, path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
