"""The pipeline's stages on whole tables and at the edges; the registered queries."""

import os

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from tests.llm.helpers import SF, edge_frame, empty_frame, with_clashes
from tillroll.llm import bpe, exact_dedup, mixing, queries, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def multiset(df):
    return sorted(map(repr, df.collect()))


def test_stages_in_order_equal_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = [lambda d: toxicity.drop_toxic(d, labels), exact_dedup.keep_one, simhash.keep_first,
             mixing.take_mix, bpe.digests]
    assert len(C.STAGES) == 5
    sizes = [docs.count()]
    for k, ((name, step), operator) in enumerate(zip(C.STAGES, plain, strict=True)):
        out = step(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert multiset(out) == multiset(operator(docs)), name
        if k < 4:
            assert out.columns == COLUMNS
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0 and sizes[4] == sizes[5]
    run = C.run(spark, SF)
    assert run.columns == docs.columns and run.count() == docs.count()


def test_stages_take_edge_rows_and_empty_tables(spark, tmp_path):
    docs = with_clashes(edge_frame(spark))
    for k, (_, step) in enumerate(C.STAGES):
        out = step(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert out.count() > 0
        docs = out if k < 4 else docs
        assert k == 4 or out.columns == with_clashes(edge_frame(spark)).columns
    for _, step in C.STAGES:
        assert step(spark, empty_frame(spark), SF).count() == 0


def test_registered_once_per_operator():
    names = set(E.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    got = queries.REGISTRY[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - set(queries.ORACLE) - {"op1_toxicity", "op11_spelling_variants"}))
def test_other_queries_cover_their_tables(spark, name):
    got = queries.REGISTRY[name](spark, SF)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(os.path.join(SF, "documents.parquet")).select("doc_id").collect()}
