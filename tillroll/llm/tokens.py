"""Whole-text token ids by the tokenizers library, one distinct word at a time.

The tokenizers handled here drop white space and never join across it, so the
ids of a text are the ids of its white-space separated pieces in order. Each
distinct piece of a batch is cut into core and tail once, and only cores and tails
a worker has not seen go to the library; the cache is bounded by ``CACHE_BYTES``.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 160 << 20     # what a worker remembers of pieces; then it starts anew
ENTRY_BYTES = 200           # of a remembered piece, besides its letters and ids
CACHE_LETTERS = 64          # longer pieces are not remembered
SLICE_BYTES = 4 << 20       # text a worker splits at once
# ASCII marks that form a token run of their own after a letter or digit.
TAIL_MARKS = ".,;:!?|)"
WORD_END = "</w>"
LINE_WORDS = 100
FEW_WORDS = 64              # so few distinct pieces are cut one by one
_PLAIN = re.compile("[a-zàâäçèéêëîïñôöùûüßáíóú]+").fullmatch

_ENCODERS: dict[tuple[str, int], "PieceEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, limit: int = CACHE_BYTES) -> "PieceEncoder":
    """The encoder of this Python worker (kept while the worker lives)."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = PieceEncoder(path, limit)
    return _ENCODERS[path, limit]


def _ends_word(core: str) -> bool:
    """Whether the last letter or digit stays one when lower-cased, so that
    marks after it begin a token run of their own."""
    last = core[-1:].lower()
    return len(last) == 1 and last.isalnum()


def _split(piece: str) -> tuple[str, str]:
    """A piece's core and its tail of marks, whose ids follow one another."""
    core = piece.rstrip(TAIL_MARKS)
    if len(core) == len(piece) or not _ends_word(core):
        core = piece
    tail = piece[len(core):]
    return core.lower() if core.isascii() and core.isalpha() else core, tail


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def _split_all(pieces: pa.Array) -> tuple[pa.Array, list[str]]:
    """``_split`` of many pieces at once: the cores, and the tails as strings."""
    core = pc.ascii_rtrim(pieces, characters=TAIL_MARKS)
    last = pc.utf8_slice_codeunits(core, -1).dictionary_encode()
    ends_word = pa.array([_ends_word(x) for x in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
    marked = pc.and_(ends_word, pc.not_equal(pc.binary_length(core), pc.binary_length(pieces)))
    core = pc.if_else(marked, core, pieces)
    core = pc.if_else(pc.and_(pc.string_is_ascii(core), pc.ascii_is_alpha(core)), pc.ascii_lower(core), core)
    tails, where = [""] * len(pieces), pc.indices_nonzero(marked)
    for i, piece, n in zip(where.to_numpy().tolist(), _strings(pieces.take(where)),
                           pc.utf8_length(core.take(where)).to_numpy().tolist(), strict=True):
        tails[i] = piece[n:]
    return core, tails


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a copy with more space, where ``n`` entries do not fit."""
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def _gather(table: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``table`` that ``index`` names, one after another, and their ends."""
    starts = ends[index]
    lengths = ends[index + 1] - starts
    out = np.concatenate(([0], np.cumsum(lengths)))
    return table[np.repeat(starts - out[:-1], lengths) + np.arange(out[-1])], out


class PieceEncoder:
    """Remembers the ids of the cores and tails of pieces: ``places`` has the place of
    each, and the ids of place i are ``table[ends[i]:ends[i + 1]]``."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        self.limit = limit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.places, self.held, self.count = {"": 0}, 0, 1
        self.table, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _encode_new(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """New strings without white space, in the order of their ids by the library,
        these ids, and how many each has. Words of plain letters go in lines of
        ``LINE_WORDS``: each ends in one token with a word end, which tells them
        apart again."""
        plain, rest = [], []
        for p in parts:
            (plain if _PLAIN(p) else rest).append(p)
        lines = [plain[i:i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        ids, ends = self._library([" ".join(x) for x in lines])
        closes = self.word_end[ids]
        before = np.concatenate(([0], np.cumsum(closes)))
        good = before[ends[1:]] - before[ends[:-1]] == np.fromiter(map(len, lines), np.int64, len(lines))
        good &= closes[ends[1:] - 1] if len(ids) else False
        if not good.all():
            kept = np.repeat(good, np.diff(ends))
            ids, closes = ids[kept], closes[kept]
            plain = [w for line, x in zip(lines, good, strict=True) if x for w in line]
            rest += [w for line, x in zip(lines, good, strict=True) if not x for w in line]
        more, ends = self._library(rest)
        return (plain + rest, np.concatenate((ids, more)),
                np.concatenate((np.diff(np.flatnonzero(closes), prepend=-1), np.diff(ends))))

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts, one after another, and their ends."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))))
        return np.fromiter(chain.from_iterable(got), np.uint32, ends[-1]), ends

    def _add(self, parts: list[str]) -> dict[str, int]:
        """Puts the ids of new strings behind all others; the place of each."""
        parts, ids, lengths = self._encode_new(parts)
        at, n = int(self.ends[self.count]), self.count
        self.table, self.ends = _room(self.table, at + len(ids)), _room(self.ends, n + len(parts) + 1)
        self.table[at:at + len(ids)] = ids
        self.ends[n + 1:n + 1 + len(parts)] = at + np.cumsum(lengths)
        self.count += len(parts)
        return dict(zip(parts, range(n, self.count)))

    def _places(self, parts: list[str]) -> np.ndarray:
        """The place of each core or tail, good until the next call."""
        if self.held > self.limit:
            self._forget()
        known = np.fromiter(map(self.places.get, parts, repeat(-1)), np.int64, len(parts))
        where = np.flatnonzero(known < 0)
        if not len(where):
            return known
        missing = [parts[i] for i in where.tolist()]
        new = dict.fromkeys(missing)
        held = self.ends[self.count]
        kept = self._add([p for p in new if len(p) <= CACHE_LETTERS])
        self.places.update(kept)
        self.held += sum(map(len, kept)) + 4 * int(self.ends[self.count] - held) + len(kept) * ENTRY_BYTES
        if len(kept) < len(new):
            count = self.count
            kept |= self._add([p for p in new if len(p) > CACHE_LETTERS])
            self.count = count      # the next strings take their places
        known[where] = [kept[p] for p in missing]
        return known

    def pieces(self, words: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each white-space free piece."""
        places = self._places([x for w in words for x in _split(w)])
        ids, ends = _gather(self.table, self.ends, places)
        return [ids[a:b].tobytes() for a, b in zip(ends[:-2:2], ends[2::2], strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: all ids (uint32) and the end of each text's ids."""
        ids, ends, total, at = [], [np.zeros(1, np.int64)], 0, 0
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES)))
            got, offs = self._encode_slice(texts.slice(at, to - at))
            ids.append(got)
            ends.append(offs[1:] + total)
            total, at = total + len(got), to
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.concatenate(ends)

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        table, ends = self._encode_distinct(words.dictionary)
        ids, ends = _gather(table, ends, words.indices.to_numpy(zero_copy_only=False))
        offsets = split.offsets.to_numpy().astype(np.int64)
        return ids, ends[offsets - offsets[0]]

    def _encode_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after another, and their ends."""
        if len(words) < FEW_WORDS:
            places = self._places([x for w in words.to_pylist() for x in _split(w)])
        else:
            core, tails = _split_all(words)
            cores = core.dictionary_encode()
            marks = {t: i for i, t in enumerate(dict.fromkeys(tails))}
            known = self._places(_strings(cores.dictionary) + list(marks))
            places = np.empty(2 * len(words), np.int64)
            places[::2] = known[cores.indices.to_numpy()]
            places[1::2] = known[len(cores.dictionary):][np.fromiter(map(marks.__getitem__, tails), np.int64, len(tails))]
        ids, ends = _gather(self.table, self.ends, places)
        return ids, ends[::2]


def vocabulary_strings(path: str) -> pa.Array:
    """The token string of every id (null where an id is unused)."""
    from tokenizers import Tokenizer
    by_id = {i: t for t, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())
