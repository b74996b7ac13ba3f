"""What the piece encoder remembers, and ids cut from and joined to one array."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.test_tokens import PARTS, texts
from tillroll.llm import rans, tokens

PATH = tokens.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_marks_and_capitals_make_no_entries_of_their_own():
    coder = tokens.PieceEncoder(PATH)
    words = ["".join(chr(97 + (i // 26 ** k) % 26) for k in range(4)) for i in range(1000)]
    coder.encode(pa.array([" ".join(w + m for w in words for m in tokens.TAIL_MARKS)]))
    held = coder.held
    assert held < 1100 * (tokens.ENTRY_BYTES + 30)
    coder.encode(pa.array([" ".join(w.capitalize() + "." for w in words)]))
    assert coder.held == held


def test_pieces_are_cut_alike_at_once_and_one_by_one():
    pieces = sorted({p for t in texts(7, 4000, 12) for p in t.split(" ")} | set(PARTS) | {"", "İ.", "ß!", "ΑΣ,", "a..", ".."})
    core, tails = tokens._split_all(pa.array(pieces, pa.string()))
    assert list(zip(core.to_pylist(), tails, strict=True)) == [tokens._split(p) for p in pieces]


@pytest.mark.parametrize("limit", [0, 5000, 1 << 20])
def test_ids_hold_while_the_cache_is_emptied_and_long_pieces_pass(library, limit, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 600)
    coder = tokens.PieceEncoder(PATH, limit)
    ts = texts(8, 400, 40) + ["q" * 70 + " ab." + "z" * 900 + ", q", "Ab.", "x" * 65 + "!"] * 2
    for _ in range(2):
        ids, ends = coder.encode(pa.array(ts))
        for t, a, b in zip(ts, ends[:-1], ends[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids
    words = ["Ab.", "q" * 70, "q" * 70 + "!", "Ab."]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.pieces(words)] == [
        library.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_ids_cut_and_joined(kind):
    ends = np.array([0, 0, 3, 3, 7])
    ids, ends = rans.with_end(np.arange(7, dtype=np.uint32) + 5, ends, 1, kind)
    values = rans.cut(ids, ends)
    assert [np.frombuffer(x, kind).tolist() for x in values.to_pylist()] == [
        [1], [5, 6, 7, 1], [1], [8, 9, 10, 11, 1]]
    back, at = rans.joined(values.slice(1, 2), kind)
    assert back.tolist() == [5, 6, 7, 1, 1] and at.tolist() == [0, 4, 5]
    back, at = rans.joined(values.slice(0, 0), kind)
    assert len(back) == 0 and at.tolist() == [0]


def test_blocks_close_at_the_document_that_fills_them(spark, monkeypatch, tmp_path):
    """Blocks run on over the batches a task gets."""
    monkeypatch.setattr(rans, "BLOCK_IDS", 10)
    rows = [(i, " ".join(["a"] * (i % 7))) for i in range(60)] + [(60, "a " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got = rans.token_files(df, out=str(tmp_path / "f")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    size = len(tokens.encoder(PATH).encode(pa.array(["a"]))[0])
    assert {r.doc_id: r.n_tokens for r in got} == {i: size * len(t.split()) + 1 for i, t in rows}
