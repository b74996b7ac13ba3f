"""The load stage: derived tables, stored once."""

from tillroll.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_line_tables_are_columns_of_one_stored_table(spark):
    """Items and details come from the same rows: loaded, moved and written once."""
    t, plain = fixtures.Tables(spark, SF), fixtures.Tables(spark, SF, materialize=False)
    items, details = t.receipt_items(), t.receipt_item_details()
    assert set(items.inputFiles()) == set(details.inputFiles())
    for got, want in ((items, plain.receipt_items()), (details, plain.receipt_item_details())):
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0


def test_a_reader_takes_only_the_columns_of_its_table(spark):
    txt = fixtures.Tables(spark, SF).receipt_items()._jdf.queryExecution().executedPlan().toString()
    schema = txt[txt.rindex("ReadSchema"):].split("\n")[0]
    assert "price" in schema and "brand_id" not in schema


def test_source_rows_are_dealt_before_they_are_widened(spark):
    """The load's only shuffle of rows holds columns of the sources; the rows stay the same."""
    t = fixtures.Tables(spark, "/root/testdata/sf0.001", materialize=False)
    for name, moved, derived in (("receipt_lines", "l_extendedprice", "global_product_id"),
                                 ("receipts", "o_totalprice", "retailer_id")):
        plain, dealt = t._derive(name), t._derive(name, buckets=4)
        assert plain.exceptAll(dealt).isEmpty() and plain.count() == dealt.count()
        plan = dealt.repartition(4, fixtures.BUCKETS[name])._jdf.queryExecution().executedPlan().toString()
        below = plan.split("Exchange hashpartitioning")
        assert len(below) == 2 and moved in below[1] and derived in below[0] and derived not in below[1]
