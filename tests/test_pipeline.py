"""Whole-pipeline semantics on hand-made tables."""

import datetime as dt
from dataclasses import replace
from decimal import Decimal

from tillroll.plans import pipeline as P


def inputs(spark):
    ts = dt.datetime(2016, 9, 1, 3, 0)
    receipts = spark.createDataFrame(
        [("r1", "c1", "1", ts, Decimal("5")), ("r1", "c1", "2", ts, Decimal("7")),
         ("r2", "c9", "1", ts, None)],
        "id string, customer_id string, retailer_id string, created_at timestamp, total_price decimal(18,2)")
    items = spark.createDataFrame(
        [("i1", Decimal("10"), Decimal("1")), ("i2", Decimal("40"), Decimal("1")),
         ("i3", None, Decimal("0"))],
        "receipt_item_id string, price decimal(18,2), quantity decimal(18,2)")
    details = spark.createDataFrame(
        [("i1", "r1", "a", "b", None, "B1", "p"), ("i2", "r2", "a", "b", None, "B1", "p"),
         ("i3", "r2", "a", "b", None, "B1", "p")],
        "receipt_item_id string, receipt_id string, primary_category_id string, "
        "secondary_category_id string, tertiary_category_id string, brand_id string, "
        "global_product_id string")
    customers = spark.createDataFrame([("c1", "F", dt.date(2000, 2, 29), None, "TX")],
                                      "id string, gender string, birth_date date, education string, state string")
    retailers = spark.createDataFrame([("1", "Grocery")], "id string, retailer_type string")
    brands = spark.createDataFrame([("B1", "Needs Verification")], "id string, name string")
    return P.Inputs(receipts, customers, retailers, brands, details, items)


def test_duplicate_receipt_ids_fan_out_and_means_use_joined_rows(spark):
    p = P.Params(clean=False, as_of="2001-03-01")
    c = P.clean_stage(inputs(spark), p)
    out = P.final_output(c, p).collect()
    # r1 appears twice: i1 -> 2 (J2) x 2 (J3) = 4 rows; i2, i3 -> 1 row each
    assert len(out) == 6
    i3 = [r for r in out if r.receipt_item_id == "i3"][0]
    # product mean over the J2 rows: (10 + 10 + 40) / 3 = 20.00 (not 16.00)
    assert i3.price == Decimal("20.00") and i3.flag_price_imputed == "yes"
    assert i3.quantity == Decimal("1.00") and i3.flag_qty_imputed == "yes"
    i1 = [r for r in out if r.receipt_item_id == "i1"]
    assert {r.retailer_id for r in i1} == {"1", "2"}
    assert all(r.customer_id == "c1" and r.age == 1 for r in i1)
    assert {r.retailer_type for r in i1} == {"Grocery", None}
    r2 = [r for r in out if r.receipt_id == "r2"][0]
    assert r2.customer_id is None                       # orphan customer -> NULL id
    assert r2.total_price == Decimal("5.00")            # retailer 1 mean: (5) -> 5.00
    assert i1[0].created_at_mst == dt.datetime(2016, 8, 31, 20, 0)


def test_run_writes_and_rereads(spark, tmp_path):
    p = P.Params(clean=False, as_of="2001-03-01")
    out = P.run(spark, inputs(spark), str(tmp_path / "final"), p, csv_out=str(tmp_path / "csv"))
    assert out.count() == 6 and len(out.columns) == 20
    assert any(f.endswith(".csv") for f in __import__("os").listdir(tmp_path / "csv"))


def test_staged_run_equals_the_lazy_plan_and_leaves_nothing(spark, tmp_path):
    """Stored cleaned and joined tables give the same rows; the run folder goes."""
    import os
    sf, p = "/root/testdata/sf0.001", P.FIXTURE_PARAMS
    a = P.final_output(P.clean_stage(P.Inputs.from_fixtures(spark, sf), p), p)
    b = P.run(spark, P.Inputs.from_fixtures(spark, sf), str(tmp_path / "final"), p)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert not [x for x in os.listdir(run_base(spark)) if x.startswith("tillroll-run-")]


def run_base(spark):
    from tillroll.session import ensure_checkpoint_dir
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return base.removeprefix("file:")


def test_a_failed_run_is_continued_at_the_first_missing_stage(spark, tmp_path, monkeypatch):
    import os

    import pytest

    from tillroll.sources import store
    sf, p, out = "/root/testdata/sf0.001", P.FIXTURE_PARAMS, str(tmp_path / "final")
    want = sorted(map(repr, P.final_output(P.clean_stage(P.Inputs.from_fixtures(spark, sf), p), p).collect()))
    seen, real = [], store.Stages.__init__
    monkeypatch.setattr(store.Stages, "__init__", lambda self, *a: (real(self, *a), seen.append(self))[0])
    finish = P.enrich.receipt_side
    monkeypatch.setattr(P.enrich, "receipt_side", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        P.run(spark, P.Inputs.from_fixtures(spark, sf), out, p)
    assert len([x for x in os.listdir(run_base(spark)) if x.startswith("tillroll-run-")]) == 1
    monkeypatch.setattr(P.enrich, "receipt_side", finish)
    got = P.run(spark, P.Inputs.from_fixtures(spark, sf), out, p)
    first, second = (s.computed for s in seen)
    assert "receipts" in first and "receipt-levels" in first and "wide-receipts" not in first
    assert "wide-receipts" in second and not set(first) & set(second)
    assert sorted(map(repr, got.collect())) == want
    assert not [x for x in os.listdir(run_base(spark)) if x.startswith("tillroll-run-")]
    # Other parameters are another run: nothing of this one would be reused.
    P.run(spark, P.Inputs.from_fixtures(spark, sf), out, replace(p, zone="+01:00"))
    assert set(seen[2].computed) == set(first) | set(second)


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from tillroll.sources import csv_io, store
    out = str(tmp_path / "t")
    for n in (3, 5):
        csv_io.write_table(spark.range(n), out)
        assert csv_io.read_table(spark, out).count() == n
    reader = csv_io.read_table(spark, out)
    with pytest.raises(Exception, match="broken"):
        csv_io.write_table(spark.range(9).withColumn("x", F.when(F.col("id") > 7, F.raise_error(F.lit("broken")))), out)
    assert csv_io.read_table(spark, out).count() == 5
    csv_io.write_table(spark.range(7), out)
    assert reader.count() == 5                      # a reader of the version before still finds it
    assert csv_io.read_table(spark, out).count() == 7
    assert len([x for x in store.names(spark, out) if x.startswith("v-")]) == store.KEPT_VERSIONS
    # A crash between the rows and the pointer: the old table stays current.
    spark.range(2).write.parquet(f"{out}/v-unfinished")
    assert csv_io.read_table(spark, out).count() == 7


def test_second_run_replaces_the_first(spark, tmp_path):
    p, out = P.Params(clean=False, as_of="2001-03-01"), str(tmp_path / "final")
    for _ in range(2):
        got = P.run(spark, inputs(spark), out, p, csv_out=str(tmp_path / "csv"))
        assert got.count() == 6
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 6


def test_tagged_rows_give_the_same_table_as_untagged_ones(spark):
    from tillroll.operators import impute
    sf, p = "/root/testdata/sf0.001", P.FIXTURE_PARAMS
    c = P.clean_stage(P.Inputs.from_fixtures(spark, sf), p)
    whole = P.impute_items(c, p, levels=True)
    split = impute.hierarchical_impute(P.joined_items(c), P.item_targets(c, p, True), p.item_levels,
                                       p.item_level_names)
    assert whole.exceptAll(split).count() == 0 and split.exceptAll(whole).count() == 0


def test_more_decimals_than_money_are_kept(spark):
    """A price of 0.004 is present: it stays, unflagged, and is not imputed."""
    src = inputs(spark)
    items = spark.createDataFrame([("i1", "0.004", "0.453"), ("i2", "40", "1"), ("i3", "(null)", "0")],
                                  "receipt_item_id string, price string, quantity string")
    from tillroll.operators import clean
    src = P.Inputs(src.receipts, src.customers, src.retailers, src.brands, src.details,
                   clean.clean_items(items))
    p = P.Params(clean=False, as_of="2001-03-01")
    row = [r for r in P.final_output(P.clean_stage(src, p), p).collect() if r.receipt_item_id == "i1"][0]
    assert row.price == Decimal("0.004") and row.flag_price_imputed == "no"
    assert row.quantity == Decimal("0.453") and row.flag_qty_imputed == "no"


def jobs_started(spark, fn) -> int:
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        fn()
        return len(tracker.getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_queries_clean_only_the_tables_they_read(spark, monkeypatch):
    from tillroll.operators import outliers
    from tillroll.plans import catalog
    sf, seen = "/root/testdata/sf0.001", []
    catalog.REGISTRY["sigma_total"](spark, sf), catalog.REGISTRY["sigma_price"](spark, sf)
    real = outliers.remove_outliers
    monkeypatch.setattr(outliers, "remove_outliers",
                        lambda df, col, *a: seen.append(col) or real(df, col, *a))
    catalog.REGISTRY["mean_total_retailer"](spark, sf)
    assert seen == ["total_price"]
    seen.clear()
    catalog.REGISTRY["customer_age"](spark, sf)
    catalog.REGISTRY["median_qty"](spark, sf)
    assert seen == ["price"]
    assert jobs_started(spark, lambda: catalog.REGISTRY["hour_counts"](spark, sf)) <= 1


def test_result_independent_of_partition_count(spark):
    sf = "/root/testdata/sf0.001"
    p = P.FIXTURE_PARAMS
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = P.final_output(P.clean_stage(P.Inputs.from_fixtures(spark, sf), p), p).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = P.final_output(P.clean_stage(P.Inputs.from_fixtures(spark, sf), p), p).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_csv_round_trip_gives_the_same_final_table(spark, tmp_path):
    """Export the fixture tables as CSV (NULL written as '(null)' in the
    sentinel columns), load them back through S1/C1/C4 and compare."""
    from tillroll.sources import csv_io, fixtures
    from tillroll.sources.schemas import SENTINEL_COLUMNS
    sf = "/root/testdata/sf0.001"
    t = fixtures.Tables(spark, sf)
    tables = {"receipts": t.receipts(), "customers": t.customers(), "retailers": t.retailers(),
              "brands": t.brands(), "receipt_item_details": t.receipt_item_details(),
              "receipt_items": t.receipt_items()}
    for name, df in tables.items():
        raw = fixtures.as_raw_strings(df, SENTINEL_COLUMNS.get(name, []))
        csv_io.write_csv(raw, str(tmp_path / f"{name}.csv"))
    p = P.FIXTURE_PARAMS
    a = P.final_output(P.clean_stage(P.Inputs.from_fixtures(spark, sf), p), p)
    b = P.final_output(P.clean_stage(P.Inputs.from_csv(spark, str(tmp_path)), p), p)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
