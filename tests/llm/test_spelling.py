"""Spelling variants against pairwise comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import edge_frame, edge_rows, empty_frame, with_clashes
from tillroll.llm import spelling as S


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[at + 1:] == (b[at + 1:] if len(a) == len(b) else b[at:])


def plain(counts, ratio=10):
    words = list(counts)
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(links[w]), None if form[w] is None else counts[form[w]]))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(rng, word, alphabet):
    at = rng.randrange(len(word) + 1)
    return rng.choice([word[:at] + rng.choice(alphabet) + word[at:], word[:at] + word[at + 1:],
                       word[:at] + rng.choice(alphabet) + word[at + 1:]])


@pytest.mark.parametrize("alphabet,lengths", [("ab", (0, 9)), ("abcdefghijklmnopqrstuvwxyzäöüÿé", (6, 14)),
                                              ("xyz\U0001F600é", (62, 67)), ("q", (1, 80))])
def test_groups_equal_pairwise_comparison(spark, alphabet, lengths):
    rng, counts = random.Random(len(alphabet)), {}
    for _ in range(60):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths)))
        n = 2 * 10 ** rng.randint(0, 5)
        for _ in range(5):
            counts[word] = n
            word, n = variants(rng, word, alphabet), rng.choice([n, max(2, n // 10), max(2, n // 11)])
    df = spark.createDataFrame([(w, n, "c") for w, n in counts.items()], "word string, n long, key string")
    want = plain(counts)
    assert got(S.spelling_groups(df.repartition(3))) == want
    assert any(r[1] is not None for r in want)


def test_chains_reach_their_last_form(spark):
    word, counts = "abcdefghijklmnopqrstuvwxyz" * 4, {}
    for k in range(7):
        counts[word] = 2 * 10 ** k
        word = word[:k * 9] + "#" + word[k * 9 + 1:]
    rows = S.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got(rows) == plain(counts)
    assert len({r.root for r in rows.collect()}) == 1


def test_nulls_repeats_and_the_empty_vocabulary(spark):
    df = spark.createDataFrame([("abcdefg", 10), ("abcdefg", 10), ("abcdefx", 2), (None, 4), ("abcdefy", None)],
                               "word string, n long")
    assert got(S.spelling_groups(df)) == [("abcdefg", None, "abcdefg", 20, 1, None),
                                          ("abcdefx", "abcdefg", "abcdefg", 2, 1, 20)]
    assert S.spelling_groups(df.limit(0)).count() == 0
    assert S.document_words(empty_frame(spark)).count() == 0


def plain_words(rows, min_chars=7):
    seen = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_chars:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def test_document_words_lose_letters_by_the_rule(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeÀÉé×÷ßXYZ") for _ in range(rng.randint(4, 11))) for _ in range(80)]
    rows = edge_rows() + [(5000 + i, ", ".join(rng.choices(words, k=90)) + "_1abcdefg2", "en", "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, edge_frame(spark).schema).repartition(3)
    want = plain_words(rows)
    assert len(want) > 50
    assert {r.word: r.n for r in S.document_words(with_clashes(df)).collect()} == want
    assert got(S.spelling_groups(S.document_words(df))) == plain(want)


def test_one_symbol_per_letter_is_not_needed(spark):
    """All words of a length share one reduced word: pairs are still verified."""
    counts = {"".join(p): 3 for p in ("aaaa", "aaab", "abab", "bbbb", "cccc", "caaa", "aaaaa", "aaa")}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    low, S.MIN_SYMBOLS, most, S.MAX_SYMBOLS = S.MIN_SYMBOLS, 1, S.MAX_SYMBOLS, 1
    try:
        assert got(S.spelling_groups(df)) == plain(counts)
    finally:
        S.MIN_SYMBOLS, S.MAX_SYMBOLS = low, most
