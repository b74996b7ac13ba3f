"""I-Match on texts whose terms are mostly outside the lexicon."""

import random

import numpy as np

from tillroll.llm import imatch as I

BAND = [f"b{i}" for i in range(3000)]


def likenesses(m, rng, vocabulary, held):
    """Of a text with its edited text (a quarter borrowed from the band), and
    with another text."""
    text = rng.sample(vocabulary, 90 - held) + rng.sample(BAND, held)
    rng.shuffle(text)
    edited = text[:68] + rng.sample(BAND, 22)
    a, b, other = (m.fingerprint(" ".join(x)) for x in (text, edited, rng.sample(BAND, 90)))
    return I.likeness(a, b), I.likeness(a, other)


def test_rare_texts_stay_as_near_their_edited_text_as_others():
    rng, m = random.Random(3), I.Matcher.of_words(sorted(BAND))
    usual = np.mean([likenesses(m, rng, BAND, 0) for _ in range(40)], axis=0)
    rare = [f"r{i}" for i in range(3000)]
    for held in (0, 1, 2, 10):
        got = np.mean([likenesses(m, rng, rare, held) for _ in range(40)], axis=0)
        assert got[0] > .7 * usual[0] > 3 * got[1]


def test_one_borrowed_band_term_changes_little():
    m = I.Matcher.of_words(["band"])
    own = " ".join(f"term{i}" for i in range(60))
    assert I.likeness(m.fingerprint(own), m.fingerprint(own + " band")) > .5
