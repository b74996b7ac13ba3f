"""What the CSV queries move and write besides the rows they return."""

import glob

from pyspark.sql import functions as F

from tillroll.plans import catalog
from tillroll.sources import csv_io, fixtures, store
from tillroll.sources.schemas import RAW

SF = "/root/testdata/sf0.001"


def test_compressed_export_reads_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_io, "FILE_ROWS", 2)
    rows = [("1", None), ("2", ""), ("3", ' a "b", \\ c '), ("4", "(null)"), ("5", "é")]
    path = str(tmp_path / "out")
    csv_io.write_csv(spark.createDataFrame(rows, "id string, name string").coalesce(1), path, "gzip")
    assert len(glob.glob(path + "/part-*.csv.gz")) == 3 and not glob.glob(path + "/part-*.csv")
    assert sorted(map(tuple, csv_io.read_csv(spark, path, RAW["brands"]).collect())) == rows
    assert sorted(map(tuple, csv_io.read_csv(spark, path, None).collect())) == rows


def test_exports_are_compressed_and_move_no_row(spark, monkeypatch):
    """Tables that are only scanned are stored as they come; stored ones are read."""
    fixtures.drop_loaded(spark)
    made = []
    monkeypatch.setattr(store, "write", lambda df, path, *how, f=store.write: made.append((path, how)) or f(df, path, *how))
    base = catalog._exported(spark, SF, "receipts", "receipt_item_details", "receipt_items")
    assert len(made) == 2 and all("/plain/" in path and how[0] is None for path, how in made)
    folder = base.removeprefix("file:")
    for name in ("receipts", "receipt_item_details", "receipt_items"):
        parts = glob.glob(f"{folder}/{name}.csv/part-*")
        assert parts and all(p.endswith(".csv.gz") for p in parts)
    lines = fixtures.Tables(spark, SF).table("receipt_lines")
    assert made[-1][1][0] == "receipt_item_id"
    plain = spark.read.parquet(next(path for path, _ in made if "receipt_lines" in path))
    assert plain.exceptAll(lines).count() == 0 and lines.exceptAll(plain).count() == 0
    catalog._exported(spark, SF, "receipt_items")
    assert len(made) == 3           # the bucketed rows serve the export too
    fixtures.drop_loaded(spark)


def test_final_table_is_not_stored_for_one_scan(spark):
    fixtures.drop_loaded(spark)
    key = catalog._final_key(spark, SF)
    typed = catalog.REGISTRY["csv_typed"](spark, SF)
    assert not fixtures.is_loaded(spark, "final", key)
    names = [F.col(c).cast("string") for c in typed.columns]
    got = typed.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))).first()
    catalog._final(spark, SF)
    assert fixtures.is_loaded(spark, "final", key)
    again = catalog.REGISTRY["csv_typed"](spark, SF)
    assert got == again.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))).first()
    fixtures.drop_loaded(spark)
