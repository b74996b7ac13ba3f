"""I-Match on texts of one or two terms."""

from tillroll.llm import imatch as I


def test_no_text_with_a_term_looks_empty():
    words = [f"w{i}" for i in range(300)]
    for m in (I.Matcher.of_words(words), I.Matcher.of_words([])):
        empty, prints = m.fingerprint(""), [m.fingerprint(w) for w in words]
        assert all(p.any() and I.likeness(p, empty) == 0.0 for p in prints)
        assert all(I.likeness(a, b) < 1.0 for a, b in zip(prints, prints[1:], strict=False))
        assert all(m.fingerprint(f"{a} {b}").any() for a, b in zip(words, words[1:], strict=False))


def test_levels_are_drawn_each_for_itself():
    _, member = I._hashes([f"w{i}" for i in range(4000)])
    import numpy as np
    bits = np.unpackbits(member, axis=1, count=I.SUBSETS)[:, :-1].reshape(4000, I.LEVELS, I.PER_LEVEL)
    for level in range(I.LEVELS):
        assert abs(bits[:, level].mean() * 2 ** (level + 2) - 1) < .4
    both = (bits[:, 0] & bits[:, 1]).mean()
    assert both < .06       # 1/4 x 1/8; nested draws have 1/8
