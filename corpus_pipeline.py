"""Corpus pipeline: toxicity -> exact dedup -> SimHash near-dedup -> source
mixing -> BPE encoding and decoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and reread as the next stage's ``docs``; all but the last
keep the columns of ``documents``.

* toxicity: the classifier is trained on the labelled rows outside the held-out
  third (their texts as ``documents`` has them); rows scored 0.7 or more go.
* exact dedup: of equal texts the row with the largest id stays.
* near dedup: of every SimHash component the row with the smallest id stays.
* mixing: every row is repeated as often as the mix takes it whole (complete
  epochs, then the rows that the fractional selection takes at least half of).
* BPE: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` per remaining row.

Each stage's operator defines what nulls, empty texts, ties, repeated rows and
empty tables give; extra columns pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import bpe, exact_dedup, mixing, simhash, toxicity
from tillroll.llm.common import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("bpe", encode_texts),
]

# The trained classifier and the tokenizer cannot be put into SQL; the tests
# hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
