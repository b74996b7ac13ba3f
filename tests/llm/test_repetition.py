"""Repetition coverage against counting every window as a tuple."""

import random
import re

import numpy as np
import pytest

from tests.llm.helpers import edge_frame, edge_rows, empty_frame, with_clashes
from tillroll.llm import repetition as R


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall("[#*$%&|<>]", text))}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]] if len(lines) < 500 else []
    out |= {"n_lines": len(lines), "n_dup_lines": len(again),
            "dup_line_chars": sum(len(re.sub("[\x20\x09-\x0d]", "", x)) for x in again)}
    for n in R.WINDOW_PERCENT:
        at = {}
        for i in range(len(words) - n + 1):
            at.setdefault(tuple(words[i:i + n]), []).append(i)
        every = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(n)}
        later = {p + k for v in at.values() for p in v[1:] for k in range(n)}
        out[f"chars_{n}"] = sum(len(words[p]) for p in later)
        if n == 8:
            out["n_repeat_words"] = len(every)
    out["base_failed"] = out["n_words"] < 20 or 100 * out["n_repeat_words"] > 30 * out["n_words"]
    out["kept"] = not out["base_failed"] and 100 * out["n_dup_lines"] <= 30 * len(lines) \
        and 100 * out["dup_line_chars"] <= 20 * out["word_chars"] \
        and all(100 * out[f"chars_{n}"] <= p * out["word_chars"] for n, p in R.WINDOW_PERCENT.items())
    return out


def texts(seed=1):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a", "é ü x", "\x0b\x0ca\x85b", "# * $%&|<> #", "a\n\n a\na\r\na\na"]
    for k in range(150):
        vocabulary = [f"w{i}É" for i in range(rng.choice([2, 5, 40, 4000]))]
        words = rng.choices(vocabulary, k=rng.randint(1, 160))
        if k % 3 == 0:
            at = rng.randrange(len(words))
            words += words[at:at + rng.randint(4, 40)]
        out.append("".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in words))
    out += ["\n".join(["one line of text here", f"other {i} words in line {i * 7}", "\n"] * 1) for i in range(5)]
    out.append("\n".join(f"line {i % 11} with some text of its own {i % 11}" for i in range(30)))
    out.append(" ".join(f"q{i}" for i in range(60_000)))
    return out


@pytest.mark.parametrize("slice_bytes", [1, 3000, 2 << 20])
def test_counts_equal_windows_as_tuples(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(R, "SLICE_BYTES", slice_bytes)
    data = texts()
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(data)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r.asDict() for r in R.judge(df.repartition(3)).collect()}
    assert len(got) == len(data)
    for i, t in enumerate(data):
        want = plain(t)
        assert {k: got[i][k] for k in want} == want, t and t[:200]
    assert {True, False} == {r["kept"] for r in got.values() if not r["base_failed"]}


def test_colliding_hashes_are_compared_word_by_word(monkeypatch):
    monkeypatch.setattr(R, "_mixed", lambda x: x * np.uint64(0))
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 300)
    w = R.Windows(words, np.array([0, 120, 300]))
    for n in (5, 8):
        every, later = w.repeats(n)
        want, more = set(), set()
        for a, b in ((0, 120), (120, 300)):
            at = {}
            for i in range(a, b - n + 1):
                at.setdefault(tuple(words[i:i + n]), []).append(i)
            want |= {i for v in at.values() if len(v) > 1 for i in v}
            more |= {i for v in at.values() for i in v[1:]}
        assert set(every) == want and set(later) == more


def test_edge_rows_and_the_empty_table(spark):
    got = R.judge(with_clashes(edge_frame(spark))).collect()
    by_text = sorted((repr(r.doc_id), r.n_words, r.n_repeat_words, r.kept) for r in got)
    want = []
    for r in edge_rows():
        p = plain(r[1])
        want.append((repr(r[0]), p["n_words"], p["n_repeat_words"], p["kept"]))
    assert by_text == sorted(want)
    assert R.judge(empty_frame(spark)).count() == 0
