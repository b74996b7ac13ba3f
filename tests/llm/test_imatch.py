"""I-Match fingerprints of texts and edited texts against a plain loop."""

import hashlib

import numpy as np
import pytest

from tests.llm.helpers import edge_frame, edge_rows, empty_frame, with_clashes
from tillroll.llm import imatch as I


def ordered(rows, spark):
    from pyspark.sql import functions as F
    texts = spark.createDataFrame([(t or "",) for _, t, *_ in rows], "t string")
    tie = {r.t: r.h for r in texts.select("t", F.xxhash64("t").alias("h")).collect()}
    return sorted(((i, t or "") for i, t, *_ in rows),
                  key=lambda x: (-(1 << 70) if x[0] is None else x[0], tie[x[1]]))


@pytest.mark.parametrize("clash", [False, True])
def test_against_a_plain_loop(spark, clash):
    rows = edge_rows(6)
    df = edge_frame(spark, 6)
    got = I.edited_neighbours(with_clashes(df) if clash else df).collect()
    seq = ordered(rows, spark)
    frequency = {}
    for _, t in seq:
        for w in I.terms(t):
            frequency[w] = frequency.get(w, 0) + 1
    n = len(seq)
    lexicon = sorted(w for w, k in frequency.items()
                     if max(2, I.LOW_SHARE * n) <= k <= max(2, I.HIGH_SHARE * n))
    above = [w for w, k in frequency.items() if k > max(2, I.HIGH_SHARE * n)]
    m = I.Matcher.of_words(lexicon, above)
    want = []
    for (i, t), (_, after) in zip(seq, seq[1:] + seq[:1], strict=True):
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        a, b, c = m.fingerprint(t), m.fingerprint(edited), m.fingerprint(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), I.as_text(a), I.as_text(b),
                     I.likeness(a, b), I.likeness(a, c)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_fingerprint_is_of_the_set_of_band_terms():
    m = I.Matcher.of_words(["ant", "bee", "cat", "dog"])
    same = m.fingerprint("Cat bee, cat ANT")
    assert np.array_equal(same, m.fingerprint("ant bee cat zebra"))
    assert not np.array_equal(same, m.fingerprint("ant bee dog"))
    assert I.likeness(same, same) == 1.0 and 0.0 <= I.likeness(same, m.fingerprint("dog")) < 1.0
    empty = m.fingerprint("")
    assert not empty.any() and I.likeness(empty, empty) == 1.0 and I.likeness(empty, same) == 0.0
    out = m.fingerprint("zebra yak")            # no band term: all its terms
    assert out.any() and np.array_equal(out, m.fingerprint("yak zebra"))


def test_edits_stay_nearer_than_neighbours(spark):
    got = I.edited_neighbours(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    near = sum(r.near_edited > r.near_next for r in got)
    assert near > .9 * len(got)


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")
    r = I.edited_neighbours(one).first()
    assert r.n_chars == 9 and r.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
    assert I.edited_neighbours(empty_frame(spark)).count() == 0
