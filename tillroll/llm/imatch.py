"""Document fingerprints by I-Match with randomised lexicons (operator 6).

1. Document frequency of every term (run of letters and digits, lower-cased)
   over all documents; the lexicon is the band of terms that at least
   ``LOW_SHARE`` (and two documents) and at most ``HIGH_SHARE`` of the
   documents hold, i.e. an inverse-document-frequency band. Frequencies add up
   to (documents x terms per document), so the terms from the band's floor up
   number at most (mean terms per document) / LOW_SHARE, however large the
   corpus. They travel as sorted 64-bit hashes: 17 bytes each with their subsets,
   34 MB for a mean of 1,000 distinct terms a document. None is dropped.
2. Random subsets of the lexicon, each drawn for itself, in levels of falling
   density, so that short and long texts both have subsets that hold a few of
   their terms, and one that holds every term: ``SUBSETS`` in all.
3. Of each text, the distinct lexicon terms are ordered and hashed once per
   subset; the fingerprint is the row of these hashes. The likeness of two
   fingerprints is the share of equal hashes among the subsets that hold a
   term of either.

Terms above the band never count, unless a text has no other. Where more than
``RARE_FROM`` of a text's other terms lie below the band (its floor rises with the
corpus, so rare vocabularies fall below it), such rare terms are used too: those
with the lowest hashes, from none of them up to all where ``RARE_ALL`` of the
terms are rare. So an edit that brings in a few terms of the band changes the
terms in use by degree only.
Texts without any term have the all-zero fingerprint; two such are alike (1.0). Null counts as
empty. ``edited_neighbours`` orders rows by id (null first), then text hash.
Extra columns are ignored; an empty table gives an empty result. A very long
text is one row's work: its distinct terms are held at once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_arrow, text_or_empty

LOW_SHARE, HIGH_SHARE = 0.0005, 0.1
LEVELS, PER_LEVEL = 8, 8            # level l keeps a term with probability 2^-(l+2)
SUBSETS = LEVELS * PER_LEVEL + 1    # the last one holds every term
RARE_FROM, RARE_ALL = 0.4, 0.65
SEED = 42                           # of Spark's xxhash64, which the terms are hashed by
FLUSH_TERMS = 1 << 20
BUCKETS_PER_PARTITION, MAX_BUCKETS = 4, 20_000
FIRST_ID = -(1 << 63)
_TERM = re.compile(r"[^\W_]+")
_POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_DRAWS = _POWER[:SUBSETS - 1]
_MASKS = np.repeat(np.array([(1 << (level + 2)) - 1 for level in range(LEVELS)], np.uint64), PER_LEVEL)
HASHED_AT_ONCE = 1 << 14


def terms(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, df)`` over all rows, combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(terms(t))
                if len(held) > FLUSH_TERMS:
                    yield out(held)
                    held = Counter()
        yield out(held)

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                           pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    return (map_arrow(docs.select(text_or_empty(text_col).alias("text")), run, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("df")))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW_SHARE,
            high: float = HIGH_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms of the band, and of those above it."""
    n = docs.count()
    known = document_frequencies(docs, text_col).where(F.col("df") >= max(2, low * n)).select(
        F.xxhash64("term").alias("h"), (F.col("df") > max(2, high * n)).alias("above")).toArrow()
    h = known["h"].to_numpy().view(np.uint64)
    above = known["above"].to_numpy().astype(bool)
    return np.sort(h[~above]), np.sort(h[above])


def _term_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w.encode("utf-8", "surrogatepass"), SEED) for w in words], np.uint64)


def _subsets(h: np.ndarray) -> np.ndarray:
    """The bits of the subsets that each term belongs to."""
    return np.concatenate([_memberships(h[i:i + HASHED_AT_ONCE])
                           for i in range(0, max(len(h), 1), HASHED_AT_ONCE)])


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each term a 64-bit hash and the bits of the subsets it belongs to."""
    h = _term_hashes(words)
    return h, _subsets(h)


def _memberships(h: np.ndarray) -> np.ndarray:
    """A draw of its own for each term and subset (the mixer of splitmix64)."""
    x = h[:, None] ^ _DRAWS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    member = np.ones((len(h), SUBSETS), bool)
    member[:, :-1] = (x ^ (x >> np.uint64(31))) & _MASKS == 0
    return np.packbits(member, axis=1)


def _places(among: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``h`` is in the sorted ``among``, and whether it is there."""
    if not len(among):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
    return at, among[at] == h


class Matcher:
    """Fingerprints over the sorted term hashes of the band and of those above."""

    def __init__(self, band: np.ndarray, above: np.ndarray, member: np.ndarray | None = None):
        self.band, self.above = band, above
        self.member = _subsets(band) if member is None else member

    @classmethod
    def of_words(cls, band: list[str], above: list[str] = ()) -> "Matcher":
        return cls(np.sort(_term_hashes(list(band))), np.sort(_term_hashes(list(above))))

    def used(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a text's term hashes those in use, and their subsets."""
        at, held = _places(self.band, h)
        found, member = h[held], self.member[at[held]]
        rare = h[~held]
        if len(rare):
            rare = rare[~_places(self.above, rare)[1]]
        if not len(found) and not len(rare):
            return h, _subsets(h)
        share = (len(rare) / (len(rare) + len(found)) - RARE_FROM) / (RARE_ALL - RARE_FROM)
        if share <= 0 or not len(rare):
            return found, member
        if share < 1:
            rare = rare[rare < np.uint64(int(share * (1 << 64)))]
        return np.concatenate([found, rare]), np.concatenate([member, _subsets(rare)])

    def fingerprint(self, text: str) -> np.ndarray:
        """One 16-bit hash per subset; 0 where the subset holds none of the terms."""
        own = terms(text)
        if not own:
            return np.zeros(SUBSETS, np.uint16)
        h, member = self.used(_term_hashes(list(own)))
        order = np.argsort(h)
        h, member = h[order], member[order]
        bits = np.unpackbits(member, axis=1, count=SUBSETS)
        which, term = np.nonzero(bits.T)        # by subset, terms in order of their hash
        counts = np.bincount(which, minlength=SUBSETS)
        starts = np.cumsum(counts) - counts
        place = np.arange(len(which)) - np.repeat(starts, counts)
        mixed = h[term] * _POWER[place & 0xFFFF]
        out = np.zeros(SUBSETS, np.uint64)
        used = counts > 0
        if len(mixed):
            out[used] = np.add.reduceat(mixed, starts[used])
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return np.where(used, (out >> np.uint64(48)) % np.uint64(65535) + np.uint64(1),
                        np.uint64(0)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float((a == b)[either].sum()) / n if n else 1.0


def as_text(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(bucket, extra, doc_id, tie, text)``: ranges of ids in sorted partitions.

    Each range also holds, as ``extra``, the first document of the next range
    (the last range: of the first), so every document finds its successor in
    its own partition. The driver sees one id per range.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(parts * BUCKETS_PER_PARTITION, MAX_BUCKETS)
    ids = docs.select(order.alias("o"))
    cuts = ids.agg(F.percentile_approx("o", [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket_of(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, o.to_numpy(), side="right").astype(np.int32))

    firsts = sorted((r["b"], r["o"]) for r in ids.withColumn("b", bucket_of("o")).groupBy("b").agg(
        F.min("o").alias("o")).collect())
    before = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}

    rows = docs.select(order.alias("o"), F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(text_col).alias("text")).withColumn("bucket", bucket_of("o"))

    @F.pandas_udf("int")
    def also_in(o: pd.Series) -> pd.Series:
        return o.map(before).astype("Int32")

    rows = rows.withColumn("also", also_in("o"))
    also = F.col("also")
    places = F.when(also.isNull(), F.array(F.struct("bucket", F.lit(False).alias("extra")))).otherwise(
        F.array(F.struct("bucket", F.lit(False).alias("extra")),
                F.struct(also.alias("bucket"), F.lit(True).alias("extra"))))
    return (rows.select(F.inline(places), "doc_id", "o", F.xxhash64("text").alias("tie"), "text")
            .repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "o", "tie"))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``; the edited text ends with the start of the next one."""
    band, above = lexicon(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast((band, above, _subsets(band)))      # bounded: see above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*held.value)
        last = None             # the row that waits for its successor
        for b in batches:
            out = []
            for bucket, extra, doc_id, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3)), strict=True):
                own = None
                if last is not None and last[0] == bucket:
                    own = matcher.fingerprint(text)
                    out.append(pair(matcher, last, text, own))
                    last = None
                if not extra:
                    last = (bucket, doc_id, text, matcher.fingerprint(text) if own is None else own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
             "near_next"]
    kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2

    def pair(matcher: Matcher, row: tuple, following: str, following_fp: np.ndarray) -> tuple:
        _, doc_id, text, fp = row
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + following[:quarter]
        changed = matcher.fingerprint(edited)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                as_text(fp), as_text(changed), likeness(fp, changed), likeness(fp, following_fp))

    rows = in_order(docs, id_col, text_col).select("bucket", "extra", "doc_id", "text")
    return map_arrow(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")
