"""Toxicity: gradient-boosted trees over dense text features, calibrated
(operator 1).

Labelled rows (a sample of at most about ``MAX_TRAIN_ROWS``, drawn by hash)
are dealt by hash into two halves for the lexicon and the trees and a fifth
for calibration.

* Lexicon: words and word beginnings that toxic texts hold more often than
  others, by smoothed log-odds and their z-score. The trees see each half
  through the lexicon of the other half, so a term that only repeats its own
  document's label gains nothing; scoring uses the lexicon of both.
* Features: lexicon densities (hits, weighted hits, the strongest hit),
  closeness of hits to second-person words, capitals, punctuation and
  obfuscation rates, length.
* Model: Spark ML gradient-boosted trees, then isotonic regression of the
  label on their probability, fitted on the rows that neither saw.

The score is the calibrated probability; the trees' own enters at the sixth
decimal, so that ties of the curve keep their order. Labels are read for
training only; lang, source and id are never features.

Null counts as empty; a text without words has all rates zero and gets a score
like any other. Ids may repeat; repeated labels train repeatedly; null labels
are left out. Without labels of both kinds every score is the share of toxic
labels (0 without labels). Extra columns are ignored; an empty table gives an
empty result. A very long text is one row's work, linear in its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_arrow, stage, text_or_empty

MAX_TRAIN_ROWS = 40_000
LEXICON_TERMS = 4_000       # most terms of a lexicon, by z-score
MIN_LOG_ODDS, MIN_Z, MIN_TOXIC = 2.5, 2.5, 3
STEM_LETTERS = (3, 4, 5, 6)
THRESHOLD = 0.7
TREES, DEPTH, STEP = 20, 4, 0.25
TIE_BREAK = 1e-6            # share of the trees' own probability: orders ties of the curve
NEAR_WORDS = 5
SCORE = "__score"
COUNTS = ("clean_0", "toxic_0", "clean_1", "toxic_1")
FEATURES = ("hit_density", "weighted_density", "strongest", "hits", "near_you", "you_density", "capitals",
            "capital_words", "exclaims", "questions", "punctuation", "obfuscated", "repeats", "digits",
            "length")
# Second-person words in the languages of the corpus.
SECOND_PERSON = frozenset("""you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi
    ton ta tes vous votre vos tú ti usted ustedes vosotros su""".split())
_WORD = re.compile(r"\w+")
_OBFUSCATED = re.compile(r"[A-Za-z]+[0-9@$*!]+[A-Za-z]+")
_REPEATED = re.compile(r"([A-Za-z])\1\1|([!?])\2")
# Look-alike marks and the letters they stand for.
_PLAIN_LETTERS = str.maketrans("013457@$!", "oieastasi")
_PUNCTUATION = np.array([0 < c < 128 and chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in range(256)])


def word_terms(words: set[str]) -> set[str]:
    """The words and their beginnings (marked by a trailing ``~``)."""
    out = set(words)
    for k in STEM_LETTERS:
        out.update(w[:k] + "~" for w in words if len(w) >= k)
    return out


def term_counts(rows: DataFrame) -> DataFrame:
    """``(term, clean_0, toxic_0, clean_1, toxic_1)``: how many texts of each
    half (column ``half``) and label hold a term, for terms of toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(4)]
        for b in batches:
            for t, y, half in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[2 * half + int(y)].update(word_terms(set(_WORD.findall(t.lower()))))
        keys = list(set().union(*held))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *[pa.array([h[k] for k in keys], pa.int64()) for h in held]],
            names=["term", *COUNTS])

    fields = ", ".join(f"{c} long" for c in COUNTS)
    return (map_arrow(rows.select("text", "toxic", "half"), run, f"term string, {fields}")
            .groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS])
            .where(F.col("toxic_0") + F.col("toxic_1") >= MIN_TOXIC))


def lexicon(counts: DataFrame, sizes: dict[tuple[int, int], int], halves: tuple[int, ...]) -> dict[str, float]:
    """Terms of toxic texts and their log-odds, over the given halves."""
    all_clean = sum(sizes.get((h, 0), 0) for h in halves)
    all_toxic = sum(sizes.get((h, 1), 0) for h in halves)
    if not all_clean or not all_toxic:
        return {}
    clean = sum((F.col(f"clean_{h}") for h in halves), F.lit(0))
    toxic = sum((F.col(f"toxic_{h}") for h in halves), F.lit(0))
    odds = F.log((toxic + 0.5) / (all_toxic + 1.0)) - F.log((clean + 0.5) / (all_clean + 1.0))
    error = F.sqrt(1.0 / (toxic + 0.5) + 1.0 / (clean + 0.5))
    best = (counts.where(toxic >= MIN_TOXIC).withColumn("odds", odds).withColumn("z", odds / error)
            .where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z))
            .orderBy(F.desc("z"), "term").limit(LEXICON_TERMS))
    return {r["term"]: r["odds"] for r in best.collect()}


class Featurizer:
    def __init__(self, lexicon: dict[str, float]):
        self.weights = lexicon
        # Three leading letters that some entry begins with: most words end here.
        self.starts = {t.rstrip("~")[:3] for t in lexicon}

    def weight(self, word: str) -> float:
        """The strongest lexicon entry among the word and its beginnings."""
        get = self.weights.get
        best = get(word, 0.0)
        for k in STEM_LETTERS:
            if len(word) < k:
                break
            best = max(best, get(word[:k] + "~", 0.0))
        return best

    def features(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        n = max(len(words), 1)
        odd = _OBFUSCATED.findall(text)
        plain = [w.lower().translate(_PLAIN_LETTERS) for w in odd]
        starts = self.starts
        hits = {w: x for w in set(words).union(plain) if w[:3] in starts and (x := self.weight(w))}
        found = [(i, hits[w]) for i, w in enumerate(words) if w in hits] if hits else []
        found += [(-1 - NEAR_WORDS - i, hits[w]) for i, w in enumerate(plain) if w in hits]
        you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        near = 0
        if found and len(you):
            at = np.array([i for i, _ in found])
            after = np.minimum(np.searchsorted(you, at), len(you) - 1)
            near = int((np.minimum(np.abs(you[after] - at), np.abs(you[np.maximum(after - 1, 0)] - at))
                        <= NEAR_WORDS).sum())
        bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        total = max(int(bytes_.sum()), 1)
        raw = text.split()
        shouts = sum(1 for w in raw if len(w) > 2 and w.isupper())
        strength = sum(x for _, x in found)
        return [len(found) / n, strength / n, max((x for _, x in found), default=0.0),
                math.log1p(len(found)), near / n, len(you) / n, float(bytes_[65:91].sum()) / total,
                shouts / max(len(raw), 1), float(bytes_[33]) / total, float(bytes_[63]) / total,
                float(bytes_[_PUNCTUATION].sum()) / total, len(odd) / n,
                len(_REPEATED.findall(text)) / n, float(bytes_[48:58].sum()) / total, math.log1p(len(words))]


def with_features(rows: DataFrame, words: dict[str, float], keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns plus the vector ``features`` of column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Featurizer(words)
        for b in batches:
            got = [maker.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.list_(pa.float64()))],
                                             names=[*keep, "values"])

    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    made = map_arrow(rows.select("text", *keep), run, f"{fields}, values array<double>")
    return made.withColumn("features", array_to_vector("values")).drop("values")


class Scorer:
    """A trained model."""

    def __init__(self, lexicon: dict[str, float], trees, curve, base: float):
        self.lexicon, self.trees, self.curve, self.base = lexicon, trees, curve, base

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """``keep`` columns plus the score (under names of their own meanwhile,
        so that they cannot clash with the model's columns)."""
        if self.trees is None:
            return docs.select(*keep, F.lit(float(self.base)).alias(SCORE))
        kept = tuple(f"kept_{i}" for i in range(len(keep)))
        rows = docs.select(text_or_empty(text_col).alias("text"),
                           *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
        made = self.curve.transform(_with_probability(self.trees, with_features(rows, self.lexicon, kept)))
        calibrated = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        return made.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)],
                           (calibrated * (1 - TIE_BREAK) + F.col("raw") * TIE_BREAK).alias(SCORE))


def _with_probability(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn(
        "raw", vector_to_array("probability")[1]).drop("prediction", "probability", "rawPrediction")


def train(docs: DataFrame, labels: DataFrame, use: Column, max_rows: int = MAX_TRAIN_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Train on the labels for which ``use`` (a condition on ``label_id``) holds."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(
        use & F.col("toxic").isin(0, 1) & F.col("label_id").isNotNull())
    n = known.count()
    draw = F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(1 << 30))
    share = min(1.0, max_rows / max(n, 1))
    drawn = known.where(draw < F.lit(int(share * (1 << 30)))).withColumn(
        "fold", F.pmod(F.xxhash64("label_id", F.lit(6)), F.lit(10)))
    # The drawn labels number about max_rows, so they are broadcast, not the texts dealt.
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = stage(texts.join(F.broadcast(drawn), F.col("id") == F.col("label_id"))
                 .select("text", "toxic", "fold"), "toxicity-train")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    base = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return Scorer({}, None, None, base)
    built = rows.where("fold < 8").withColumn("half", (F.col("fold") % 2).cast("int"))
    spare = rows.where("fold >= 8")
    each = {(r["half"], r["toxic"]): r["count"] for r in built.groupBy("half", "toxic").count().collect()}
    if {(h, y) for h in (0, 1) for y in (0, 1)} - set(each):
        return Scorer({}, None, None, base)
    counts = stage(term_counts(built), "toxicity-terms")
    kept = ("toxic", "fold")
    crossed = with_features(built.where("half = 0"), lexicon(counts, each, (1,)), kept).unionByName(
        with_features(built.where("half = 1"), lexicon(counts, each, (0,)), kept))
    words = lexicon(counts, each, (0, 1))
    # The sample is bounded; a few partitions spare the many small jobs of the
    # boosting most of their tasks.
    few = max(1, min(8, max_rows // 20_000))
    made = stage(crossed.unionByName(with_features(spare, words, kept)), "toxicity-features").coalesce(few)
    trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1,
                          maxBins=64, minInstancesPerNode=4).fit(made.where("fold < 8"))
    return Scorer(words, trees, calibration(_with_probability(trees, made.where("fold >= 8"))), base)


def calibration(spare: DataFrame):
    """Isotonic regression of ``toxic`` on ``raw``; equal probabilities are one
    weighted point. Two anchors keep the curve defined (and 0 to 1) however few
    spare rows there are."""
    anchors = spare.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "raw double, label double")
    points = (spare.select("raw", F.col("toxic").cast("double").alias("label")).unionByName(anchors)
              .groupBy("raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight")))
    return IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(points)


def not_held_out(col: str = "label_id") -> Column:
    """crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3 != 1


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    scorer = train(docs, labels, not_held_out())
    held = F.coalesce(~not_held_out("doc_id"), F.lit(False))
    return scorer.score(docs).select("doc_id", held.alias("held_out"), F.col(SCORE).alias("score"),
                                     (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored at the threshold or above; same columns."""
    scorer = train(docs, labels, not_held_out(), text_col=text_col)
    scored = scorer.score(docs, tuple(docs.columns), text_col)
    return scored.where(F.col(SCORE) < THRESHOLD).select(*docs.columns)
