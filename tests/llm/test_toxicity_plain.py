"""Parts of the toxicity classifier against plain loops: lexicon, features, curve, score."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import toxicity as T

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    out = set()
    for w in T._WORD.findall(text.lower()):
        out.add(w)
        out.update(w[:k] + "~" for k in T.STEM_LETTERS if len(w) >= k)
    return out


def plain_lexicon(rows, halves):
    """From (text, toxic, half) rows: log-odds of terms in toxic over clean texts."""
    rows = [r for r in rows if r[2] in halves]
    size = [sum(1 for r in rows if r[1] == y) for y in (0, 1)]
    held = {}
    for text, y, _ in rows:
        for t in plain_terms(text):
            held.setdefault(t, [0, 0])[y] += 1
    scored = []
    for t, (clean, toxic) in held.items():
        if toxic < T.MIN_TOXIC:
            continue
        odds = math.log((toxic + .5) / (size[1] + 1)) - math.log((clean + .5) / (size[0] + 1))
        z = odds / math.sqrt(1 / (toxic + .5) + 1 / (clean + .5))
        if odds >= T.MIN_LOG_ODDS and z >= T.MIN_Z:
            scored.append((-z, t, odds))
    return {t: odds for _, t, odds in sorted(scored)[:T.LEXICON_TERMS]}


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"),
        F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))


@pytest.mark.parametrize("halves", [(0,), (1,), (0, 1)])
def test_lexicon(labelled, halves):
    rows = [tuple(r) for r in labelled.collect()]
    sizes = {(h, y): sum(1 for r in rows if r[2] == h and r[1] == y) for h in (0, 1) for y in (0, 1)}
    got = T.lexicon(T.term_counts(labelled), sizes, halves)
    want = plain_lexicon(rows, halves)
    assert set(got) == set(want) and want
    assert all(abs(got[t] - want[t]) < 1e-9 for t in want)


def plain_features(text, weights):
    words = T._WORD.findall(text.lower())
    odd = T._OBFUSCATED.findall(text)
    plain = [w.lower().translate(T._PLAIN_LETTERS) for w in odd]

    def weight(w):
        return max([weights.get(w, 0.0)] + [weights.get(w[:k] + "~", 0.0) for k in T.STEM_LETTERS if len(w) >= k])

    n, data = max(len(words), 1), text.encode("utf-8", "surrogatepass")
    hits = [(i, weight(w)) for i, w in enumerate(words) if weight(w) > 0]
    places = [i for i, _ in hits]
    far = [weight(w) for w in plain if weight(w) > 0]
    strengths = [x for _, x in hits] + far
    you = [i for i, w in enumerate(words) if w in T.SECOND_PERSON]
    near = sum(1 for i in places if any(abs(i - y) <= T.NEAR_WORDS for y in you))
    raw, total = text.split(), max(len(data), 1)

    def rate(keep):
        return sum(1 for c in data if keep(c)) / total

    return [len(strengths) / n, sum(strengths) / n, max(strengths, default=0.0), math.log1p(len(strengths)), near / n,
            len(you) / n, rate(lambda c: 65 <= c <= 90),
            sum(1 for w in raw if len(w) > 2 and w.isupper()) / max(len(raw), 1),
            rate(lambda c: c == 33), rate(lambda c: c == 63), rate(lambda c: T._PUNCTUATION[c]), len(odd) / n,
            len(T._REPEATED.findall(text)) / n, rate(lambda c: 48 <= c <= 57), math.log1p(len(words))]


def test_features(labelled):
    rng = random.Random(1)
    weights = {"foul~": 3.0, "foulest": 4.0, "idiot": 5.0, "dum~": 2.0}
    parts = ["you", "YOU", "your", "foul", "foulest!", "id1ot", "1d!ot", "dumb", "nice", "WORD", "day", "aaah!!", "42",
             "d\u00fc", "vous", "?", "\n"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(300)]
    texts += ["", " ", "!!!", "x" * 5000, "you idiot " * 3000] + [r.text for r in labelled.limit(60).collect()]
    maker = T.Featurizer(weights)
    for t in texts:
        assert np.allclose(maker.features(t), plain_features(t, weights), rtol=0, atol=1e-12), t[:80]
    assert len(T.FEATURES) == len(maker.features(""))


def pooled(points):
    """Pool adjacent violators: sorted (x, label, weight) -> values at the x."""
    blocks = []
    for x, y, w in points:
        blocks.append([y * w, w, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w2, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w2, blocks[-1][2] + xs]
    return {x: s / w for s, w, xs in blocks for x in xs}


def test_calibration(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        x = round(rng.random(), 2)      # many ties
        rows.append((x, int(rng.random() < x * x)))
    spare = spark.createDataFrame(rows, "raw double, toxic int")
    curve = T.calibration(spare)
    at = {}
    for x, y in [*rows, (0.0, 0), (1.0, 1)]:
        at.setdefault(x, []).append(y)
    want = pooled([(x, sum(ys) / len(ys), len(ys)) for x, ys in sorted(at.items())])
    got = {r.raw: r.prediction for r in curve.transform(spare.select("raw").distinct()).collect()}
    assert all(abs(got[x] - want[x]) < 1e-9 for x in got)


def test_score_is_the_calibrated_probability(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = T.train(docs, labels, T.not_held_out())
    scored = {r.doc_id: r[T.SCORE] for r in scorer.score(docs).collect()}
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = T._with_probability(scorer.trees, T.with_features(texts, scorer.lexicon, ("doc_id",)))
    xs, ys = scorer.curve.boundaries.toArray(), scorer.curve.predictions.toArray()
    for r in made.select("doc_id", "raw").collect():
        curve = float(np.interp(r.raw, xs, ys))
        assert abs(scored[r.doc_id] - curve) <= T.TIE_BREAK + 1e-12
    assert len(scored) == docs.count() and sum(s >= T.THRESHOLD for s in scored.values()) > 0
