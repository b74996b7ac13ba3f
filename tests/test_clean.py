import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import clean, outliers
from tillroll.sources import csv_io
from tillroll.sources.schemas import RAW


def test_csv_null_rules(spark):
    d = tempfile.mkdtemp(prefix="tillroll-csv-")
    path = os.path.join(d, "items.csv")
    with open(path, "w") as f:
        f.write('receipt_item_id,price,quantity\n1,"",none\n2,,(null)\n3,1.50,2\n')
    df = csv_io.read_csv(spark, path, RAW["receipt_items"])
    rows = {r.receipt_item_id: r for r in df.collect()}
    assert rows["1"].price == "" and rows["2"].price is None and rows["2"].quantity == "(null)"
    cleaned = clean.null_if_token(df, ["quantity"])
    assert {r.receipt_item_id: r.quantity for r in cleaned.collect()}["2"] is None


def test_strict_and_lenient_cast(spark):
    df = spark.createDataFrame([("1", "1.5"), ("2", "abc")], "id string, price string")
    lenient = clean.to_decimal(df, ["price"], lenient=True).collect()
    assert [r.price for r in lenient] == [Decimal("1.50"), None]
    with pytest.raises(Exception):
        clean.to_decimal(df, ["price"]).collect()


def test_recode_pad_and_flags(spark):
    df = spark.createDataFrame([("none", "", "yes"), ("BA", "F", "no")], "education string, gender string, f string")
    out = clean.pad_char(clean.recode(df, "education", {"none": None}), "gender", 1)
    out = clean.flags_to_bool(out, ["f"])
    rows = out.collect()
    assert rows[0].education is None and rows[0].gender == " " and rows[0].f is True
    assert rows[1].education == "BA" and rows[1].f is False
    brands = spark.createDataFrame([("b1", "Needs Verification"), ("b2", "Acme")], "id string, name string")
    assert [r.name for r in clean.clean_brands(brands).collect()] == ["No Info", "Acme"]


def test_caps_then_sigma(spark):
    vals = [Decimal(v) for v in (1, 2, 3, 2, 1, 2, 3, 2, 1, 2, 3, 2, 1, 2, 3, 2, 500, 20000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, price decimal(18,2)")
    out = outliers.remove_outliers(df, "price", cap=10000, k=3.0)
    got = {r.id: r.price for r in out.collect()}
    assert got[17] is None          # above the cap
    assert got[16] is None          # outside 3 sigma of the capped values
    assert got[0] == Decimal("1.00")
    b = outliers.sigma_bounds(df.where(F.col("price") < 10000), "price").first()
    assert b.lower_bound < 0 < b.upper_bound


def test_csv_quotes_backslashes_blanks_and_line_breaks(spark):
    d = tempfile.mkdtemp(prefix="tillroll-csv-")
    plain, broken = os.path.join(d, "a.csv"), os.path.join(d, "b.csv")
    with open(plain, "w") as f:
        f.write('id,name\n1,"A ""B"", C"\n2,"A ""B"""\n3,"ends\\"\n4, x \n5,""\n6,\n')
    got = {r.id: r.name for r in csv_io.read_csv(spark, plain, RAW["brands"]).collect()}
    assert got == {"1": 'A "B", C', "2": 'A "B"', "3": "ends\\", "4": " x ", "5": "", "6": None}
    with open(broken, "w") as f:
        f.write('id,name\n1,"two\nlines"\n2,b\n')
    got = csv_io.read_csv(spark, broken, RAW["brands"], multi_line=True).collect()
    assert {r.id: r.name for r in got} == {"1": "two\nlines", "2": "b"}
    with pytest.raises(Exception):
        csv_io.read_csv(spark, broken, RAW["brands"]).collect()


def test_csv_export_text(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="tillroll-csv-"), "out")
    rows = [("1", 'A "B", C'), ("2", " "), ("3", " x "), ("4", ""), ("5", None), ("6", "ends\\")]
    csv_io.write_csv(spark.createDataFrame(rows, "id string, name string").coalesce(1), d)
    part = [f for f in os.listdir(d) if f.endswith(".csv")]
    text = open(os.path.join(d, part[0])).read()
    assert text == 'id,name\n1,"A ""B"", C"\n2, \n3, x \n4,""\n5,\n6,ends\\\n'
    back = {r.id: r.name for r in csv_io.read_csv(spark, d, RAW["brands"]).collect()}
    assert back == dict(rows)


def test_padding_of_declared_char_columns(spark):
    df = spark.createDataFrame([("c", "", None, "BA", "T"), ("d", "F", None, "none", "TX")],
                               "id string, gender string, birth_date date, education string, state string")
    got = {r.id: (r.gender, r.state, r.education) for r in clean.clean_customers(df).collect()}
    assert got == {"c": (" ", "T ", "BA"), "d": ("F", "TX", None)}


def test_digits_beyond_the_storage_fail_loudly(spark):
    df = spark.createDataFrame([("1", "0.004", "0.453")], "id string, price string, quantity string")
    row = clean.to_decimal(df, ["price", "quantity"]).first()
    assert row.price == Decimal("0.004") and row.quantity == Decimal("0.453")
    bad = spark.createDataFrame([("1", "0.0000004")], "id string, price string")
    with pytest.raises(Exception):
        clean.to_decimal(bad, ["price"]).collect()
    assert clean.to_decimal(bad, ["price"], lenient=True).first().price is None
