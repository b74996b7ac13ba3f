"""Toxicity: accuracy on held-out rows and defined results at the edges."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, edge_frame, edge_rows, empty_frame, with_clashes
from tillroll.llm import toxicity as T

BAD = ["snarfing", "snarfed", "blorg", "grumpf"]


def corpus(n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        ws = [f"word{rng.randint(0, 300)}" for _ in range(rng.randint(3, 60))]
        toxic = rng.random() < .2
        if toxic:
            for _ in range(rng.randint(2, 5)):
                ws.insert(rng.randint(0, len(ws)), rng.choice(BAD))
        rows.append((i, " ".join(ws), "en", "s0", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module", autouse=True)
def fewer_trees():
    with pytest.MonkeyPatch.context() as m:
        m.setattr(T, "TREES", 8)
        yield


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(
        edge_frame(spark, 5).withColumn("doc_id", F.col("doc_id") + 100_000))
    marks = spark.createDataFrame(labels + [(None, 1, 1), (100_000, None, None)],
                                  "doc_id long, quality int, toxic int")
    return docs, marks, T.score_documents(docs, marks).collect()


def test_every_row_has_a_score(scored):
    docs, _, got = scored
    assert len(got) == docs.count()
    for r in got:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_held_out_rows_are_told_apart(scored):
    _, labels = corpus()
    truth = {i: y for i, _, y in labels}
    held = [r for r in scored[2] if r.held_out and r.doc_id in truth]
    pos = [r.score for r in held if truth[r.doc_id]]
    neg = [r.score for r in held if not truth[r.doc_id]]
    wins = sum((p > q) + .5 * (p == q) for p in pos for q in neg)
    assert wins / (len(pos) * len(neg)) > 0.97
    assert sum(p >= .7 for p in pos) > .85 * len(pos) and sum(q >= .7 for q in neg) <= .02 * len(neg)


def test_drop_toxic_keeps_clean_rows_and_columns(spark, scored):
    docs, marks, got = scored
    frame = with_clashes(docs)
    out = T.drop_toxic(frame, marks)
    assert out.columns == frame.columns
    assert out.count() == sum(r.score < .7 for r in got)
    assert out.where("fp <> 'clash' OR features <> 'clash' OR text IS NULL").count() == \
        sum(t is None for _, t, *_ in edge_rows(5))


def test_without_usable_labels(spark):
    docs = edge_frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in T.score_documents(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 1) for i in range(60)], "doc_id long, quality int, toxic int")
    assert {r.score for r in T.score_documents(
        spark.createDataFrame([(i, "a", "en", "s", 1) for i in range(60)], SCHEMA), one).collect()} == {1.0}
    assert T.score_documents(empty_frame(spark), none).count() == 0


def test_features_of_odd_texts():
    f = T.Featurizer({"blorg": 3.0, "snarf~": 0.0, "snar~": 2.0})
    names = dict(zip(T.FEATURES, range(len(T.FEATURES)), strict=True))
    for text in ("", " ", "!!!", "\U0001F600", "x" * 100_000):
        assert len(f.features(text)) == len(names)
    got = f.features("you BLORG!! snarfing")
    assert got[names["hit_density"]] == 2 / 3 and got[names["strongest"]] == 3.0
    assert got[names["near_you"]] == 2 / 3 and got[names["capital_words"]] == 1 / 3
    assert f.features("bl0rg")[names["hits"]] > 0 and f.features("bl0rg")[names["obfuscated"]] == 1.0
