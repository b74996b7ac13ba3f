"""Exact dedup and SimHash near-dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import edge_frame, edge_rows, empty_frame, with_clashes
from tillroll.llm import exact_dedup as X
from tillroll.llm import simhash as S


def low(i):
    return -(1 << 70) if i is None else i


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup_matches_brute_force(spark, clash):
    rows = edge_rows()
    df = edge_frame(spark)
    got = X.exact_dedup(with_clashes(df) if clash else df).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max(ids, key=low)
    kept = sorted((r.text_sha256, low(r.doc_id)) for r in got if r.kept)
    assert kept == sorted((s, low(max(ids, key=low))) for s, ids in by_sha.items())


def test_keep_one_keeps_columns_and_one_row_per_text(spark):
    out = X.keep_one(with_clashes(edge_frame(spark)))
    assert out.columns == with_clashes(edge_frame(spark)).columns
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in edge_rows()})


def test_empty_table(spark):
    assert X.exact_dedup(empty_frame(spark)).count() == 0
    assert X.keep_one(empty_frame(spark)).count() == 0
    assert S.simhash_components(empty_frame(spark)).count() == 0
    assert S.keep_first(empty_frame(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_quotient_filters_are_lossless_and_merge(seed):
    rng = np.random.default_rng(seed)
    prefix_bits = [0, 3, 6, 20][seed]
    top = np.uint64(5 << (64 - prefix_bits)) if prefix_bits >= 3 else np.uint64(0)

    def draw(n):
        raw = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        if prefix_bits:
            raw = (raw >> np.uint64(prefix_bits)) | top
        raw[: n // 3] = raw[0]
        fps, counts = np.unique(raw, return_counts=True)
        return raw, X.CountingQuotientFilter.build(fps, counts, prefix_bits)
    raws, filters = zip(*[draw(n) for n in (1, 2, 700, 3000)], strict=True)
    read = [X.CountingQuotientFilter.loads(f.dumps()) for f in filters]
    for raw, f in zip(raws, read, strict=True):
        fps, counts = np.unique(raw, return_counts=True)
        assert np.array_equal(f.entries()[0], fps) and np.array_equal(f.entries()[1], counts)
    fps, counts = np.unique(np.concatenate(raws), return_counts=True)
    got = X.CountingQuotientFilter.loads(X.merge(list(read)).dumps()).entries()
    assert np.array_equal(got[0], fps) and np.array_equal(got[1], counts)


def test_colliding_fingerprints_are_told_apart_by_bytes(spark, monkeypatch):
    """All texts share one fingerprint: only equal bytes form a class."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(X.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(df).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def slow_fingerprint(text, width=4):
    raw = text.encode()
    ws = [w for w in "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) for b in raw).split(" ")]
    import re
    ws = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in raw))
    if not ws:
        return 0
    grams = [b" ".join(ws[i:i + width]) for i in range(max(1, len(ws) - width + 1))]
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprint_matches_its_definition():
    for _, t, *_ in edge_rows():
        if t is not None and len(t) < 20_000:
            assert S.fingerprint(t) == slow_fingerprint(t)
    long = " ".join(map(str, range(70_000)))
    assert S.fingerprint(long) == slow_fingerprint(long)


def test_masks_cover_every_pair_within_the_radius():
    masks = S.covering_masks(4)
    assert len(masks) == 31 and min(m.bit_count() for m in masks) >= 31
    rng = random.Random(2)
    for _ in range(20_000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & flip == 0 for m in masks)


def components(ids, fps, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("clash", [False, True])
def test_components_match_brute_force(spark, clash):
    rows = edge_rows(1)
    df = edge_frame(spark, 1)
    got = S.simhash_components(with_clashes(df) if clash else df).collect()
    fps = [S.fingerprint(t or "") for _, t, *_ in rows]
    want = components([i for i, *_ in rows], fps)
    expect = sorted((low(i), f"{f:016x}", low(c)) for (i, *_), f, c in zip(rows, fps, want, strict=True))
    assert sorted((low(r.doc_id), r.fingerprint, low(r.component_id)) for r in got) == expect


@pytest.mark.parametrize("block", [40, 512])
def test_links_in_crowded_buckets(spark, block):
    """Chains of fingerprints around few centres, buckets far above the block."""
    rng = random.Random(3)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(70):
            centre_now = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                centre_now ^= 1 << b
            fps.add(centre_now)
    fps = sorted(fps)
    rows = [(S._signed(f), i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "fp long, rep long")
    from tillroll.llm.common import connected_components
    got = {r.node: r.component for r in connected_components(S.near_links(df, 4, block)).collect()}
    want = components(list(range(len(fps))), fps)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_keep_first_keeps_one_row_per_component(spark):
    df = with_clashes(edge_frame(spark, 1))
    out = S.keep_first(df)
    assert out.columns == df.columns
    rows = edge_rows(1)
    want = components([i for i, *_ in rows], [S.fingerprint(t or "") for _, t, *_ in rows])
    kept = sorted(low(r.doc_id) for r in out.collect())
    expect = sorted(low(i) for i, _ in {(i, t or "") for (i, t, *_), c in zip(rows, want, strict=True) if c == i})
    assert kept == expect
