"""BPE by chunk reuse and the rANS files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import edge_frame, edge_rows, empty_frame, with_clashes
from tillroll.llm import bpe, rans, tokens

PATH = tokens.default_tokenizer()
PARTS = [*"abcdeABC  \n\t.,|'’sİßéΣσ \x0b\x1c <|>19٣你好한국가", "<|endoftext|>", "'s", "'re", "<|ENDOFTEXT|>", " the "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_pieces_equal_the_library(library):
    ts = texts(1, 5000, 30) + ["", " ", "a" * 5000, "ab" * 300 + " z"]
    ids, ends = tokens.encoder(PATH).encode(pa.array(ts))
    for t, a, b in zip(ts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_chunk_joins_are_exact(library, monkeypatch):
    monkeypatch.setattr(bpe, "MIN_CHUNK", 8)
    monkeypatch.setattr(bpe, "MAX_CHUNK", 64)
    monkeypatch.setattr(bpe, "MEAN_BITS", 4)
    ts = texts(2, 800, 300) + ["x" * 500, "ab" * 400 + " z", ""]
    ts += ts[:50]
    coder = bpe.ChunkCoder(PATH)
    got = coder.encode([bpe.chunks(t) for t in ts])
    for t, g in zip(ts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert coder.encoded < sum(len(bpe.chunks(t)) for t in ts)


def test_cuts_depend_on_content_alone():
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefgh ij") for _ in range(40_000))
    whole, moved = set(bpe.chunks(body)), bpe.chunks("some other beginning " + body)
    assert "".join(moved) == "some other beginning " + body
    assert len(whole & set(moved)) >= 0.8 * len(moved)
    assert "".join(bpe.chunks("z" * 100_000)) == "z" * 100_000
    assert max(map(len, bpe.chunks("z" * 100_000))) <= bpe.MAX_CHUNK


def expect(library, rows):
    out = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        back = library.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clash", [False, True])
def test_digests_match_the_library(spark, library, clash):
    rows = edge_rows(3) + [(5000 + i, t, "en", "s", 1) for i, t in enumerate(texts(5, 60, 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = bpe.digests(with_clashes(df.repartition(3)) if clash else df).collect()
    assert sorted(map(tuple, got), key=repr) == expect(library, rows)


def test_token_files_round_trip(spark, library, monkeypatch, tmp_path):
    monkeypatch.setattr(rans, "BLOCK_IDS", 5000)
    rows = edge_rows(4)
    out = str(tmp_path / "files")
    got = rans.token_files(with_clashes(edge_frame(spark, 4)), out=out, file_bytes=40_000).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    at, ids_seen = 0, []
    for r in by_start:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
        ids_seen.append(-(1 << 70) if r.doc_id is None else r.doc_id)
    assert ids_seen == sorted(ids_seen)

    def crc(t):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, rans.END_ID]
        return zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((repr(r.doc_id), zlib.crc32(r.ids)) for r in got) == sorted(
        (repr(i), crc(t)) for i, t, *_ in rows)
    import glob
    assert len(glob.glob(out + "/part-*")) > 1


def test_empty_tables(spark):
    assert bpe.digests(empty_frame(spark)).count() == 0
    assert rans.token_files(empty_frame(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 70_000, 200_000])
def test_blocks_decode_whole_and_from_checkpoints(n):
    rng = np.random.default_rng(n)
    share = 1 / np.arange(1, 5001)
    ids = rng.choice(5000, n, p=share / share.sum()).astype(np.uint32)
    counts = np.bincount(ids, minlength=6000)
    counts[5999] += 1
    table = rans.FrequencyTable.from_counts(counts)
    assert int(table.freq.sum()) == 1 << rans.SCALE_BITS
    block = rans.encode_block(ids, table)
    assert np.array_equal(rans.read_block(block, table), ids)
    for step in range(rans.CHECKPOINT_STEPS, -(-n // rans.LANES), rans.CHECKPOINT_STEPS):
        assert np.array_equal(rans.read_block(block, table, step), ids[step * rans.LANES:])


def test_damage_is_found():
    ids = np.arange(3000, dtype=np.uint32) % 7
    table = rans.FrequencyTable.from_counts(np.bincount(ids, minlength=9))
    data = bytearray(rans.frame([1], np.array([3000]), ids, table) + rans.FRAME_END)
    assert [x[0] for x in rans.frames(bytes(data))] == [[1]]
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        list(rans.frames(bytes(data)))
