"""Quality rules by repetition coverage (operator 13).

Which part of a text's characters lies inside passages the text has had before?
Words (``[^\\x20\\x09-\\x0D]+``) get a number each; the hash of every window of n
words comes from one running sum (a rolling hash, one subtraction a window), for
several n. Windows of one text with equal hashes are sorted side by side and
compared word by word, so a collision never counts. The characters (code points
in words) inside windows that repeat an earlier one, for each n, and inside lines
equal to an earlier one are held against limits in percent, in integers.

A text fails the base rule with under ``MIN_WORDS`` words or with over
``REPEAT_PERCENT`` % of its words in windows of ``BASE_WINDOW`` words found twice
or more (first included); it is kept if it passes that and every coverage limit.

Texts are cut nowhere and judged each for itself: no shuffle, and equal rows and
ids give equal results. Null texts count as empty (no words: base rule failed).
Batches are worked off in slices of ``SLICE_BYTES``; a longer text is a slice of
its own, in memory proportional to its words. Null ids stay null, extra columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_arrow, text_or_empty

MIN_WORDS, REPEAT_PERCENT, BASE_WINDOW = 20, 30, 8
#: Words of a window -> greatest share of characters in repeated windows, in percent.
WINDOW_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_PERCENT, LINE_CHARS_PERCENT = 30, 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 2 << 20
_NO_BLANKS = dict.fromkeys(map(ord, BLANKS))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Rolling hashes over the words of several texts, one after another.

    ``words``: a number per word, equal for equal words; ``ends``: the end of
    each text's words.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        self.words, self.ends = words, ends
        counts = np.diff(ends, prepend=0)
        self.text = np.repeat(np.arange(len(ends)), counts)
        self.left = np.repeat(ends, counts) - np.arange(len(words))     # words up to the text's end
        terms = _mixed(words.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(words))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        self.shift = _powers(_INVERSE, len(words))
        self.salt = _mixed(self.text.astype(np.uint64) + np.uint64(1 << 40))

    def repeats(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``(all, later)``: starts of the windows of ``n`` words that their text
        holds twice or more, and of those among them that are not the first."""
        starts = np.flatnonzero(self.left >= n)
        hashes = _mixed((self.sums[starts + n] - self.sums[starts]) * self.shift[starts] + self.salt[starts])
        order = np.argsort(hashes, kind="stable")
        same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        a, b = starts[order[same]], starts[order[same + 1]]
        equal = self.text[a] == self.text[b]
        for k in range(n):
            equal &= self.words[a + k] == self.words[b + k]
        if not equal.all():
            a, b = self._compared(starts, n)
        return np.union1d(a, b), np.unique(b)

    def _compared(self, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring equal windows by sorting the words themselves."""
        columns = [self.words[starts + k] for k in range(n)] + [self.text[starts]]
        order = np.lexsort(columns)
        equal = np.ones(max(0, len(starts) - 1), bool)
        for c in columns:
            equal &= c[order[1:]] == c[order[:-1]]
        same = np.flatnonzero(equal)
        return starts[order[same]], starts[order[same + 1]]

    def covered(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Whether each word lies in a window of ``n`` words at one of ``starts``."""
        steps = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + n, -1)
        return np.cumsum(steps[:-1]) > 0

    def per_text(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[self.ends] - sums[np.concatenate(([0], self.ends[:-1]))]


def repeated_lines(text: str) -> tuple[int, int, int]:
    """Lines with a word; how many equal an earlier one; word characters in those."""
    seen, lines, again, chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            if line in seen:
                again += 1
                chars += len(line.translate(_NO_BLANKS))
            seen.add(line)
    return lines, again, chars


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text: ``_COLUMNS`` and ``chars_<n>`` for each window length."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten().dictionary_encode()
    chars = pc.utf8_length(flat.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.indices.to_numpy(zero_copy_only=False)
    real = chars[words] > 0 if len(words) else np.zeros(0, bool)        # blanks at the ends split off ""
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    words, ends = words[real], np.concatenate(([0], np.cumsum(real)))[offsets[1:]].astype(np.int64)
    chars = chars[words] if len(words) else np.zeros(0, np.int64)
    w = Windows(words, ends)
    plain = texts.to_pylist()
    lines = np.array([repeated_lines(t) for t in plain], np.int64).reshape(-1, 3)
    out = {"n_words": np.diff(ends, prepend=0), "word_chars": w.per_text(chars),
           "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in plain], np.int64),
           "n_lines": lines[:, 0], "n_dup_lines": lines[:, 1], "dup_line_chars": lines[:, 2]}
    for n in sorted({*WINDOW_PERCENT, BASE_WINDOW}):
        every, later = w.repeats(n)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = w.per_text(w.covered(every, n))
        if n in WINDOW_PERCENT:
            out[f"chars_{n}"] = w.per_text(chars * w.covered(later, n))
    return out


def coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``_COLUMNS`` and ``chars_<n>`` (word characters inside windows
    of n words that repeat an earlier one) of every row."""
    names = [*_COLUMNS, *(f"chars_{n}" for n in WINDOW_PERCENT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                base = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES)))
                got = measure(b.column(1).slice(at, to - at))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, to - at), *(pa.array(got[c].astype(np.int64)) for c in names)],
                    names=["doc_id", *names])
                at = to

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"))
    kind = dict(rows.dtypes)["doc_id"]
    return map_arrow(rows, run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``coverage`` plus ``base_failed`` and ``kept``."""
    c = F.col
    failed = (c("n_words") < MIN_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * REPEAT_PERCENT)
    fine = ((c("n_dup_lines") * 100 <= c("n_lines") * LINE_PERCENT)
            & (c("dup_line_chars") * 100 <= c("word_chars") * LINE_CHARS_PERCENT))
    for n, percent in WINDOW_PERCENT.items():
        fine &= c(f"chars_{n}") * 100 <= c("word_chars") * percent
    return coverage(docs, id_col, text_col).withColumns({"base_failed": failed, "kept": ~failed & fine})
