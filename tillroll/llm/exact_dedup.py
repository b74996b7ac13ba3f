"""Exact deduplication with counting quotient filters (operator 4).

1. Every text gets a 64-bit fingerprint (``xxhash64``). Each partition packs
   its fingerprints into counting quotient filters: the high bits (quotient)
   are kept as bitmaps of occupied quotients and run ends, the low bits
   (remainder) as a sorted array, repeats as counters.
2. Filters are cut by leading fingerprint bits into segments; the slices of a
   segment meet in one task and merge by their sorted remainders. No bit is
   lost, so the merged counts are those of the whole corpus.
3. Texts whose fingerprint counts more than one go on to byte verification: a
   ``groupBy`` on the text itself, combined map-side, so a text that makes up
   a third of all rows costs each task one row.

Texts are compared after ``normalise`` (default: no change); null counts as
empty. Empty texts are a class like any other. Rows that repeat both id and
text are one class with one row kept. A null id is the smallest id. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import ship, text_or_empty

SEGMENT_ROWS = 1 << 21      # fingerprints a merged segment is sized for
MIN_SEGMENT_BITS, MAX_SEGMENT_BITS = 6, 20
FLUSH_ROWS = 1 << 20        # fingerprints a task packs into one filter


class CountingQuotientFilter:
    """A static counting quotient filter over 64-bit fingerprints that share
    their leading ``prefix_bits``.

    ``occupied``: one bit per quotient; ``run_ends``: one bit per slot, set on
    the last remainder of a run; ``remainders``: sorted within each run;
    ``counted``: one bit per slot, set where a counter follows; ``counters``:
    the counts of those slots.
    """

    __slots__ = ("prefix_bits", "prefix", "quotient_bits", "occupied", "run_ends",
                 "remainders", "counted", "counters")

    @classmethod
    def build(cls, fps: np.ndarray, counts: np.ndarray, prefix_bits: int) -> "CountingQuotientFilter":
        """From sorted distinct fingerprints (uint64, one prefix) and their counts."""
        f = cls()
        f.prefix_bits, n = prefix_bits, len(fps)
        f.prefix = int(fps[0]) >> (64 - prefix_bits) if prefix_bits else 0
        f.quotient_bits = min(max(1, int(n - 1).bit_length()), 63 - prefix_bits)
        rest = fps & np.uint64((1 << (64 - prefix_bits)) - 1)
        rem_bits = np.uint64(f.remainder_bits)
        quotient = (rest >> rem_bits).astype(np.int64)
        occupied = np.zeros(1 << f.quotient_bits, np.uint8)
        occupied[quotient] = 1
        ends = np.ones(n, np.uint8)
        ends[:-1] = quotient[1:] != quotient[:-1]
        f.occupied, f.run_ends = np.packbits(occupied), np.packbits(ends)
        f.remainders = rest & np.uint64((1 << f.remainder_bits) - 1)
        more = counts > 1
        f.counted, f.counters = np.packbits(more), counts[more].astype(np.int64)
        return f

    @property
    def remainder_bits(self) -> int:
        return 64 - self.prefix_bits - self.quotient_bits

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts, as they went in."""
        n = len(self.remainders)
        ends = np.flatnonzero(np.unpackbits(self.run_ends, count=n))
        quotients = np.flatnonzero(np.unpackbits(self.occupied)[:1 << self.quotient_bits])
        lengths = np.diff(ends, prepend=-1)
        high = np.repeat(quotients.astype(np.uint64), lengths) << np.uint64(self.remainder_bits)
        top = np.uint64(self.prefix << (64 - self.prefix_bits) if self.prefix_bits else 0)
        counts = np.ones(n, np.int64)
        counts[np.unpackbits(self.counted, count=n).astype(bool)] = self.counters
        return top | high | self.remainders, counts

    def dumps(self) -> bytes:
        width = (self.remainder_bits + 7) // 8
        low = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8)
                                   .reshape(-1, 8)[:, :width])
        head = np.array([self.prefix_bits, self.prefix, self.quotient_bits,
                         len(self.remainders), len(self.counters)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.occupied, self.run_ends, low, self.counted,
                                              self.counters.astype("<i8")))

    @classmethod
    def loads(cls, data: bytes) -> "CountingQuotientFilter":
        f = cls()
        f.prefix_bits, f.prefix, f.quotient_bits, n, m = np.frombuffer(data, "<i8", 5).tolist()
        width, at = (f.remainder_bits + 7) // 8, 40

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)
        f.occupied = take(((1 << f.quotient_bits) + 7) // 8)
        f.run_ends = take((n + 7) // 8)
        low = np.zeros((n, 8), np.uint8)
        low[:, :width] = take(n * width).reshape(n, width)
        f.remainders = low.view("<u8").reshape(n).astype(np.uint64)
        f.counted = take((n + 7) // 8)
        f.counters = take(8 * m).view("<i8").astype(np.int64)
        return f


def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """Lossless merge of filters over one prefix: sorted runs are interleaved
    by (quotient, remainder), counts of equal fingerprints add up."""
    parts = [f.entries() for f in filters]
    fps = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(fps, kind="stable")
    fps, counts = fps[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], fps[1:] != fps[:-1])))
    return CountingQuotientFilter.build(fps[first], np.add.reduceat(counts, first),
                                        filters[0].prefix_bits)


def _slices(fps: np.ndarray, segment_bits: int) -> pd.DataFrame:
    """The filters of one batch of fingerprints, one per segment."""
    fps, counts = np.unique(fps, return_counts=True)
    segment = (fps >> np.uint64(64 - segment_bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    ends = np.append(starts[1:], len(fps))
    return pd.DataFrame({
        "segment": segment[starts],
        "cqf": [CountingQuotientFilter.build(fps[a:b], counts[a:b], segment_bits).dumps()
                for a, b in zip(starts, ends, strict=True)]})


def repeated_fingerprints(fps: DataFrame, segment_bits: int) -> DataFrame:
    """``(fp, fp_count)`` of the fingerprints (column ``fp``) that occur more than once."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held.append(b["fp"].to_numpy().view(np.uint64))
            n += len(b)
            if n >= FLUSH_ROWS:
                yield _slices(np.concatenate(held), segment_bits)
                held, n = [], 0
        if n:
            yield _slices(np.concatenate(held), segment_bits)

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = merge([CountingQuotientFilter.loads(x) for x in pdf["cqf"]])
        got, counts = merged.entries()
        more = counts > 1
        return pd.DataFrame({"fp": got[more].view(np.int64), "fp_count": counts[more]})

    ship(fps.sparkSession)
    return (fps.select("fp").mapInPandas(pack, "segment long, cqf binary")
            .groupBy("segment").applyInPandas(unite, "fp long, fp_count long"))


def exact_dedup(docs: DataFrame, normalise: Callable[[Column], Column] | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    text = text_or_empty(text_col)
    text = normalise(text) if normalise else text
    rows = docs.count()
    bits = min(max((rows // SEGMENT_ROWS).bit_length(), MIN_SEGMENT_BITS), MAX_SEGMENT_BITS)

    repeated = repeated_fingerprints(docs.select(F.xxhash64(text).alias("fp")), bits)
    # Byte verification of the rows whose fingerprint repeats. The aggregate's
    # key holds the text, so equal means equal in every byte.
    suspects = docs.select(F.col(id_col).alias("doc_id"), text.alias("body"),
                           F.xxhash64(text).alias("fp")).join(
        repeated.hint("shuffle_hash"), "fp")
    classes = (suspects.groupBy("body").agg(F.max("doc_id").alias("keep_id"),
                                            F.count(F.lit(1)).alias("group_size"))
               .where("group_size > 1")
               .select(F.sha2("body", 256).alias("sha"), "keep_id", "group_size"))
    # One lean row per (id, text); exact repeats of a row are unfolded again.
    lean = (docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
            .groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    joined = lean.join(classes, F.col("text_sha256") == F.col("sha"), "left")
    return (joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("doc_id",
                    F.when(F.col("sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    ((F.col("copy") == 1) & (F.col("sha").isNull()
                                             | F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"),
                    "text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; same columns."""
    kept = exact_dedup(docs, id_col=id_col, text_col=text_col).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(text_or_empty(text_col), 256)
    rows = docs.withColumn("__own_sha", sha)
    hit = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__id"))
                    & (F.col("__own_sha") == F.col("__sha")))
    nth = F.row_number().over(Window.partitionBy(id_col, "__own_sha").orderBy(F.lit(1)))
    return hit.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
