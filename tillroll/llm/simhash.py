"""SimHash near-deduplication by covering locality-sensitive hashing (operator 3).

Fingerprint: bytes A-Z lower-cased, words split at ASCII white space, every
shingle of ``width`` words (repeats included) hashed with XXH64 (seed 42); a
bit is set where more than half of the hashes have it.

Candidates: each of the 64 bit positions gets a vector phi(i) of
GF(2)^(radius+1); mask v (every non-zero vector) keeps the positions with
<phi(i), v> = 1. The at most ``radius`` positions in which a close pair
differs cannot span the space, so some mask v is orthogonal to all of them:
the pair agrees on that whole mask and meets in its table. No close pair is
missed, whatever the data.

Links: in a bucket (table, masked value) all distinct fingerprints are
compared by the popcount of their xor, and only a spanning star of each
connected group leaves the task, never all pairs. A bucket above ``block``
rows is cut into blocks and every pair of blocks becomes a group of its own,
so no task gathers a large bucket and none of its pairs is skipped.

Definitions: null text is empty; texts without words have fingerprint zero
and link like any other; one to ``width`` words form one shingle. Repeated
ids or rows keep one result row each. A row with a null id gets its
fingerprint and its class's component; a class with only null ids has a null
component. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import connected_components, map_arrow, stage, text_or_empty

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
BLOCK = 512                # most fingerprints of one bucket compared in one group
HASH_CHUNK = 1 << 16       # shingles whose bits are counted at once


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASH_CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(starts[at:at + HASH_CHUNK], ends[at:at + HASH_CHUNK], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks; positions take the non-zero vectors in turn,
    so every mask keeps about half of the bits."""
    top = 1 << (radius + 1)
    phi = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i, p in enumerate(phi) if (p & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row; ``fp`` is the signed view of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "text_hash", "fp"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text"))
    return map_arrow(rows, run, "doc_id long, text_hash long, fp long")


def _stars(bucket: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int,
           cross: np.ndarray | None = None) -> pd.DataFrame:
    """Links within runs of equal ``bucket`` (sorted), as one star per connected
    group; ``cross`` (0/1) restricts a block pair to pairs across the blocks."""
    n = len(fp)
    left, right, step = [], [], 1
    alive = np.arange(n - 1)
    while len(alive):
        alive = alive[alive + step < n]
        alive = alive[bucket[alive] == bucket[alive + step]]
        close = np.bitwise_count(fp[alive] ^ fp[alive + step]) <= radius
        if cross is not None:
            close &= cross[alive] != cross[alive + step]
        left.append(alive[close])
        right.append(alive[close] + step)
        step += 1
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return pd.DataFrame({"u": rep[moved], "v": rep[root[moved]]})


def near_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the fingerprints within ``radius``.

    ``distinct(fp, rep)``: one row per fingerprint with its id.
    """
    tables = F.array(*[F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(_signed(m))))
                       for v, m in enumerate(covering_masks(radius))])
    probes = distinct.select(F.explode(tables).alias("bucket"), "fp", "rep")
    sized = probes.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        """Buckets lie together (the window sorted them); a bucket that a batch
        cuts is held over to the next one. At most ``block`` rows are held."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            bucket = cols[0]
            cut = len(bucket) if bucket[-1] != bucket[0] else 0
            if cut:
                cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1
            if cut:
                yield out(_stars(bucket[:cut], cols[1][:cut].view(np.uint64), cols[2][:cut], radius))
            held = [c[cut:] for c in cols]
        if held is not None:
            yield out(_stars(held[0], held[1].view(np.uint64), held[2], radius))

    def out(links: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(links["u"].to_numpy(), pa.int64()),
                                           pa.array(links["v"].to_numpy(), pa.int64())], names=["u", "v"])

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        side = (pdf["b"].to_numpy() == j).astype(np.int8) if i != j else None
        return _stars(np.zeros(len(pdf), np.int64), pdf["fp"].to_numpy().view(np.uint64),
                      pdf["rep"].to_numpy(), radius, side)

    few = map_arrow(sized.where(F.col("n") <= block).select("bucket", "fp", "rep"), small, "u long, v long")
    blocks = F.ceil(F.col("n") / F.lit(block))
    many = (sized.where(F.col("n") > block)
            .withColumn("b", F.pmod(F.xxhash64("fp", F.lit(7)), blocks))
            .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .select("bucket", "fp", "rep", "b", F.least("b", "o").alias("i"),
                    F.greatest("b", "o").alias("j"))
            .groupBy("bucket", "i", "j").applyInPandas(pair, "u long, v long"))
    return few.unionByName(many)


def simhash_components(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``."""
    marked = stage(fingerprints(docs, width, id_col, text_col), "simhash")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comps = connected_components(near_links(classes.where("rep IS NOT NULL"), radius))
    by_fp = (classes.join(comps, F.col("rep") == F.col("node"), "left")
             .select(F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")))
    return (marked.join(by_fp, F.col("fp") == F.col("class_fp"), "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                    "text_hash"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of every component; same columns.

    A row is told by its id and the hash of its text; of rows that repeat both,
    one stays.
    """
    got = simhash_components(docs, id_col=id_col, text_col=text_col)
    firsts = got.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hit = docs.withColumn("__own", F.xxhash64(text_or_empty(text_col))).join(
        firsts, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")))
    nth = F.row_number().over(Window.partitionBy(id_col, "__own").orderBy(F.lit(1)))
    return hit.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
