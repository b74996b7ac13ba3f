"""What the archives' dictionary is trained on."""

import glob
import random

from tillroll.llm import warc as W


def long_pages(rng, n):
    return [(i, f"http://h/{i:05}", " ".join(f"w{rng.randint(0, 9000)}" for _ in range(9000))) for i in range(n)]


def test_long_pages_have_a_dictionary(spark, tmp_path):
    rows = long_pages(random.Random(1), 12)
    assert all(len(r[2]) > 40_000 for r in rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    W.write_archives(df, str(tmp_path / "w"))
    files = [d for d in (open(f, "rb").read() for f in glob.glob(str(tmp_path / "w/part-*"))) if d]
    assert files and all(int.from_bytes(d[4:8], "little") > 1000 for d in files)
    got = {r.page_id: bytes(r.payload).decode() for r in W.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {i: html for i, _, html in rows}


def test_sample_is_of_distinct_payloads_and_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(W, "train", lambda records: seen.extend(records) or b"x")
    monkeypatch.setattr(W, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(W, "SAMPLE_BYTES", 60_000)
    rng = random.Random(2)
    rows = long_pages(rng, 30) + [(100 + i, f"http://a/{i}", "hot page " * 50) for i in range(200)]
    rows += [(1000 + i, f"http://z/{i}", f"page {i} é " + "y" * 30) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert W.dictionary.__code__.co_argcount == 3 and W.dictionary(df, "url", "html") == b"x"
    assert len(seen) == 60 and sum(len(W.parse(r)[1]) for r in seen) <= 60_000
    assert sum(b"hot page" in r for r in seen) <= 1
    assert any(len(W.parse(r)[1]) == 1000 for r in seen)         # of a long page, its share
    first, seen[:] = list(seen), []
    W.dictionary(df.repartition(7), "url", "html")
    assert seen == first
