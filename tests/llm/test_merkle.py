"""Merkle manifests against a plain tree."""

import random
import zlib
from hashlib import sha256

import pytest

from tests.llm.helpers import edge_frame, edge_rows, empty_frame, with_clashes
from tillroll.llm import merkle as M


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    """``(root, proof of each leaf as [(before, after), ...])``."""
    proofs, spans = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, wide = [], []
        for a in range(0, len(hashes), 16):
            run = hashes[a:a + 16]
            for j in range(len(run)):
                for leaf in spans[a + j]:
                    proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(h(*run))
            wide.append([x for s in spans[a:a + 16] for x in s])
        hashes, spans = up, wide
    return hashes[0], proofs


def plain(rows):
    def leaf(r):
        return h(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(r[1]))

    def lowered(t):
        return t and "".join(c.lower() if c.isascii() else c for c in t)

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for s in sources:
        members[s] = sorted((r for r in rows if r[3] == s),
                            key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in members[s]])
    root, top = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for r, path in zip(members[s], trees[s][1], strict=True):
            path = path + top[k]
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            x = leaf((r[0], lowered(r[1]), *r[2:]) if change else r)
            for a, b in path:
                x = h(a, x, b)
            out.append((repr(r[0]), leaf(r), trees[s][0], root, h(*[a + b for a, b in path]), x, x == root))
    return sorted(out)


def got(df):
    return sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                  for r in df.collect())


def rows_of(sizes, seed=0):
    rng, rows = random.Random(seed), []
    for s, n in sizes.items():
        rows += [(rng.randrange(10 ** 6), rng.choice(["Abc É", "x", "", None, "no caps", "ÀZ"]), rng.choice(["en", None]),
                  s, rng.choice([None, 5])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, None: 1}, {None: 300, "": 2, "z": 16, "é": 33, "a/1": 1},
                                   {f"s{i}": 1 + i % 3 for i in range(40)}, {"big": 4100, "b": 2}])
def test_manifest_equals_the_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    df = spark.createDataFrame(rows, edge_frame(spark).schema).repartition(5)
    out = got(M.document_manifest(df))
    assert out == plain(rows)
    if len(rows) > 100:
        assert 0 < sum(not r[-1] for r in out) < len(out) / 3


def test_edge_rows_and_the_empty_table(spark):
    df = with_clashes(edge_frame(spark)).withColumnsRenamed({"fp": "place", "rep": "leaf", "label": "tree", "size": "members"})
    assert got(M.document_manifest(df)) == plain(edge_rows())
    assert M.document_manifest(empty_frame(spark)).count() == 0


def test_more_rows_climb_than_the_default_limit_allows(spark):
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        rows = rows_of({"a": 100})
        df = spark.createDataFrame(rows, edge_frame(spark).schema)
        assert got(M.document_manifest(df)) == plain(rows)
        assert spark.conf.get(name) == "3"
    finally:
        spark.conf.set(name, before)
