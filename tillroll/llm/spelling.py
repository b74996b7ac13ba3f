"""Spelling variant grouping over a reduced alphabet (operator 11).

Two words are near when one inserted, deleted or replaced code point turns one
into the other. Letters are hashed to a few symbols, so a word becomes a reduced
word over a small alphabet whose full one-edit neighbourhood is short, whatever
the real alphabet. An edit of the word is an edit of the reduced word or leaves
it as it is (a letter replaced by another of the same symbol), hence near words
have reduced words that are equal or neighbours:

1. Every word is filed under its reduced word.
2. Every word generates the neighbours of its reduced word. The neighbourhood is
   symmetric, so each pair of neighbouring reduced words is generated once, by
   the longer one (its deletions are the other's insertions) or, at equal
   length, by the one with the higher symbol (its replacements by lower ones).
3. Generated and filed reduced words are joined, by 64-bit hashes of them, and
   the original strings are verified inside the join: nothing but near pairs
   leaves it, and a hash collision costs one comparison.

The number of symbols follows from the number of words of a length, so that the
reduced words outnumber the words (``symbol_counts``): the candidates per word
do not grow with the vocabulary. Hashes are rolling, one step per neighbour, so
a word of n letters costs O(n) however long it is; words over ``CARRIED`` code
points travel as ids and their strings are fetched for the candidates only.

A word's form is its near word of largest count (ties: smallest in code-point
order) if that count is ``ratio`` times its own or more. Counts grow by the ratio
along forms, so a chain has at most log(largest count) steps and pointer doubling
finds the roots in the logarithm of that many rounds.

Null words or counts are left out; a repeated word is one word with its counts
added; the empty word is near every word of one code point. Extra columns are
ignored, an empty vocabulary gives an empty result. Of documents
(``document_words``): null and empty texts have no words, a null id is written
as the empty text, repeated rows count each time, long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_arrow, stage

MIN_CHARS, MIN_COUNT = 7, 2
FORM_RATIO = 10
MIN_SYMBOLS, MAX_SYMBOLS = 3, 32
ROOM = 4                    # reduced words per word of a length, at least
CARRIED = 64                # longer words travel as ids
SLICE = 4096                # words of one length whose neighbours are made at once
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUN = "[A-Za-zÀ-ÿ]{%d,}"
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def document_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                   drop_one_in: int = 31) -> DataFrame:
    """``word, n``: letter runs of the texts, A-Z lower-cased, with one letter
    lost in every ``drop_one_in``-th run as a hash of document and run has it.

    Counts are combined before the shuffle, so a word that makes up a third of
    all runs costs one row per task.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(_RUN % min_chars), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    # Only A-Z are lower-cased; where all letters are ASCII the quicker lower() does that.
    ascii_only = F.octet_length("run") == F.char_length("run")
    runs = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(
        F.translate("run", _UPPER, _UPPER.lower())).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % drop_one_in == 0, shorter).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).where(F.char_length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def symbol_counts(vocabulary: DataFrame) -> dict[int, int]:
    """Symbols per word length, for lengths up to ``CARRIED`` (one row each):
    the fewest whose reduced words are ``ROOM`` times the words."""
    sizes = (vocabulary.groupBy(F.least(F.char_length("word"), F.lit(CARRIED + 1)).alias("chars"))
             .agg(F.count(F.lit(1)).alias("words")).collect())
    return {r["chars"]: min(MAX_SYMBOLS, max(MIN_SYMBOLS, math.ceil((ROOM * r["words"]) ** (1 / max(1, r["chars"])))))
            for r in sizes}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = _mixed(np.arange(1, MAX_SYMBOLS + 1, dtype=np.uint64))


def _keys(sums: np.ndarray, chars: int) -> np.ndarray:
    """Rolling hashes of reduced words of ``chars`` symbols as join keys."""
    return _mixed(sums + _mixed(np.array([chars + 1000], np.uint64))).view(np.int64)


def reduced(points: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol (0 .. symbols - 1) of every code point."""
    return (_mixed(points.astype(np.uint64) + np.uint64(77)) % np.uint64(symbols)).astype(np.int64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def own_keys(points: np.ndarray, symbols: int) -> np.ndarray:
    """Key of the reduced word of each row of ``points`` (words of one length)."""
    words, chars = points.shape
    terms = _VALUES[reduced(points, symbols)] * _powers(chars)
    return _keys(terms.sum(axis=1, dtype=np.uint64) if chars else np.zeros(words, np.uint64), chars)


def neighbour_keys(points: np.ndarray, symbols: int, fewer: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, keys)``: the generated neighbours of each row's reduced word.

    Deletions are reduced words of the length below, over its ``fewer`` symbols;
    of a run of one symbol a single deletion is kept, since all are the same.
    """
    words, chars = points.shape
    if not chars:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    powers = _powers(chars)
    low = reduced(points, fewer)
    terms = _VALUES[low] * powers
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    shorter = upto - terms + (upto[:, -1:] - upto) * _BASE_INVERSE
    heads = np.ones(low.shape, bool)
    heads[:, 1:] = low[:, 1:] != low[:, :-1]
    rows, keys = [np.nonzero(heads)[0]], [_keys(shorter[heads], chars - 1)]
    own = reduced(points, symbols)
    total = (_VALUES[own] * powers).sum(axis=1, dtype=np.uint64)[:, None]
    for t in range(symbols - 1):
        higher = own > t
        changed = total + (_VALUES[t] - _VALUES[own]) * powers
        rows.append(np.nonzero(higher)[0])
        keys.append(_keys(changed[higher], chars))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(vocabulary: DataFrame, counts: dict[int, int], generated: bool) -> DataFrame:
    """``key, id, word, n``: each word under its own key, or under its neighbours'."""

    def symbols(chars: int) -> int:
        return counts.get(min(chars, CARRIED + 1), MIN_SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.utf8_length(b.column(1)).to_numpy(zero_copy_only=False)
            order = np.argsort(lengths, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                chars = int(lengths[group[0]]) if len(group) else 0
                for at in range(0, len(group), max(1, SLICE * 16 // max(16, chars))):
                    part = b.take(pa.array(group[at:at + max(1, SLICE * 16 // max(16, chars))]))
                    text = "".join(part.column(1).to_pylist())
                    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, chars) \
                        if chars else np.zeros((part.num_rows, 0), np.uint32)
                    if generated:
                        rows, keys = neighbour_keys(points, symbols(chars), symbols(chars - 1))
                        per_word = np.bincount(rows, minlength=part.num_rows)
                        keys = keys[np.argsort(rows, kind="stable")]
                    else:
                        keys, per_word = own_keys(points, symbols(chars)), np.ones(part.num_rows, np.int64)
                    ends = np.concatenate(([0], np.cumsum(per_word))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                        names=["id", "word", "n", "keys"])

    listed = map_arrow(vocabulary.select(F.xxhash64("word").alias("id"), "word", "n"), run,
                       "id long, word string, n long, keys array<long>")
    return listed.select(F.explode("keys").alias("key"), "id", "word", "n")


def _candidates(vocabulary: DataFrame, counts: dict[int, int], carried: list[str], one_edit: Column,
                ordered: Column) -> DataFrame:
    """Rows ``m_...`` and ``f_...`` of words whose reduced words are neighbours or
    equal and for which ``one_edit`` holds."""
    def side(name: str, generated: bool) -> DataFrame:
        return _keyed(vocabulary, counts, generated).select(
            F.col("key").alias(f"{name}_key"), *[F.col(c).alias(f"{name}_{c}") for c in carried])

    filed, meet = side("f", False), F.col("m_key") == F.col("f_key")
    found = side("m", True).join(filed, meet & one_edit)
    # Equal reduced words: the letter replaced had the same symbol.
    equal = side("m", False).join(filed, meet & ordered & one_edit)
    return found.unionByName(equal).drop("m_key", "f_key")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of near words, in both directions.

    ``vocabulary`` (``word, n``, words distinct) should be a stored table: it
    is read several times.
    """
    counts, chars = symbol_counts(vocabulary), F.char_length("word")
    verified = F.levenshtein("m_word", "f_word", 1) == 1
    columns = ["m_word", "m_n", "f_word", "f_n"]
    short = _candidates(vocabulary.where(chars <= CARRIED), counts, ["word", "n"], verified,
                        F.col("m_word") > F.col("f_word"))
    # Words of CARRIED code points have neighbours one longer.
    far = vocabulary.where(chars >= CARRIED)
    strings = far.select(F.xxhash64("word").alias("id"), "word", "n")
    fetched = (_candidates(far, counts, ["id"], F.lit(True), F.col("m_id") > F.col("f_id")).distinct()
               .join(strings.toDF("m_id", "m_word", "m_n"), "m_id").join(strings.toDF("f_id", "f_word", "f_n"), "f_id")
               .where((F.greatest(F.char_length("m_word"), F.char_length("f_word")) > CARRIED) & verified))
    pairs = short.select(columns).unionByName(fetched.select(columns).distinct()).toDF("word", "n", "near", "near_n")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                          F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root`` of the words with a form; no chain is longer than ``steps``."""
    root = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        onward = root.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        root = stage(root.join(onward, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root")), "roots")
    return root


def spelling_groups(vocabulary: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``vocabulary``
    (``word``, ``n``)."""
    words = stage(vocabulary.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word")
                  .agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    best = F.when(F.col("near_n") >= F.col("n") * ratio, F.struct((-F.col("near_n")).alias("less"), "near"))
    near = stage(near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best")), "near-words")
    forms = near.where("best IS NOT NULL").select("word", F.col("best.near").alias("form"))
    bounds = words.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    steps = 0
    if bounds["least"]:
        while bounds["least"] * ratio ** (steps + 1) <= bounds["most"]:
            steps += 1
    roots = _roots(forms, steps)
    return (words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("form_n")))
