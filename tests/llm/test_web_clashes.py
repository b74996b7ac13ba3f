"""Extra columns named like the operators' own change nothing."""

from pyspark.sql import functions as F

from tests.llm.helpers import CLASHES, SF
from tillroll.llm import urlrules as U
from tillroll.llm import warc as W


def clashing(pages, names):
    return pages.withColumns({c: F.lit("clash") for c in {*names, *CLASHES} - {"page_id", "url", "html"}})


def rows(df):
    return df.columns, sorted(map(repr, df.collect()))


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    plain = U.filter_urls(pages)
    assert rows(U.filter_urls(clashing(pages, [*plain.columns, "t", "tokens", "count"]))) == rows(plain)


def test_archives(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    plain = W.archive_round_trip(pages)
    assert rows(W.archive_round_trip(clashing(pages, [*plain.columns, "digest", "first", "value", "h"]))) == rows(plain)
