"""The band of the I-Match lexicon."""

import numpy as np

from tillroll.llm import imatch as I


def test_terms_above_the_band_never_count():
    above = [f"the{i}" for i in range(40)]
    m = I.Matcher.of_words([f"band{i}" for i in range(50)], above)
    for own in (" ".join(f"band{i}" for i in range(0, 50, 3)), "band1 rare7 rare8 rare9", "rare1 rare2"):
        plain = m.fingerprint(own)
        assert np.array_equal(plain, m.fingerprint(" ".join(above) + " " + own))
    # A text of such terms alone has them only: it must not look empty.
    only = m.fingerprint("the1 the2")
    assert only.any() and not np.array_equal(only, m.fingerprint("the3 the4"))


def test_rare_terms_stay_out_where_the_band_holds_enough():
    m = I.Matcher.of_words([f"band{i}" for i in range(50)], ["the"])
    own = " ".join(f"band{i}" for i in range(12))
    assert np.array_equal(m.fingerprint(own), m.fingerprint(own + " " + " ".join(f"rare{i}" for i in range(8))))


def test_lexicon_against_a_plain_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text or "" for r in docs.select("text").collect()]
    df = {}
    for t in texts:
        for w in I.terms(t):
            df[w] = df.get(w, 0) + 1
    n = len(texts)
    floor, top = max(2, I.LOW_SHARE * n), max(2, I.HIGH_SHARE * n)
    band, above = I.lexicon(docs)
    assert np.array_equal(band, np.sort(I._term_hashes([w for w, k in df.items() if floor <= k <= top])))
    assert np.array_equal(above, np.sort(I._term_hashes([w for w, k in df.items() if k > top])))
    assert len(above) <= sum(df.values()) / n / I.HIGH_SHARE


def test_few_texts_use_rare_terms(spark):
    """At production size the band's own terms decide for nearly all texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = I.Matcher(*I.lexicon(docs))
    texts = [r.text or "" for r in docs.select("text").collect()]
    rare = 0
    for t in texts:
        h = I._term_hashes(list(I.terms(t)))
        rare += bool(len(h)) and not I._places(m.band, m.used(h)[0])[1].all()
    print("texts that use rare terms:", rare, "of", len(texts))
    assert rare < .1 * len(texts)
