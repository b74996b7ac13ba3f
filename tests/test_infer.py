"""Types inferred from every row of a CSV."""

import datetime as dt
import math
from decimal import Decimal

import pytest

from tillroll.sources import csv_io, infer


def column(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    out = infer.typed(df)
    return out.dtypes[0][1], [r.x for r in out.collect()]


@pytest.mark.parametrize("values,kind,expect", [
    (["1", None, "-20", "+3"], "bigint", [1, None, -20, 3]),
    (["007", "12"], "bigint", [7, 12]),
    (["1", "2.50", ".5"], "decimal(3,2)", [Decimal("1.00"), Decimal("2.50"), Decimal("0.50")]),
    (["1234567890123456789"], "decimal(19,0)", [Decimal(1234567890123456789)]),
    (["1", "2e3"], "double", [1.0, 2000.0]),
    (["1" * 39], "double", [float("1" * 39)]),
    (["true", "FALSE", None], "boolean", [True, False, None]),
    (["true", "1"], "string", ["true", "1"]),
    (["2017-02-28", "2016-02-29"], "date", [dt.date(2017, 2, 28), dt.date(2016, 2, 29)]),
    (["2017-02-29"], "string", ["2017-02-29"]),
    (["2017-02-28", "2017-02-28 10:00:01.5"], "timestamp_ntz",
     [dt.datetime(2017, 2, 28), dt.datetime(2017, 2, 28, 10, 0, 1, 500000)]),
    (["2017-02-28T10:00:00", "2017-02-28T10:00:00Z"], "string",
     ["2017-02-28T10:00:00", "2017-02-28T10:00:00Z"]),
    (["2017-02-28", "5"], "string", ["2017-02-28", "5"]),
    (["1", ""], "string", ["1", ""]),
    ([None, None], "string", [None, None]),
    ([], "string", []),
    (["yes", "no"], "string", ["yes", "no"]),
    ([" 1"], "string", [" 1"]),
    (["-", "."], "string", ["-", "."]),
])
def test_narrowest_type_that_holds_every_row(spark, values, kind, expect):
    assert column(spark, values) == (kind, expect)


def test_special_doubles(spark):
    kind, got = column(spark, ["NaN", "-Infinity", "1.5"])
    assert kind == "double" and math.isnan(got[0]) and got[1:] == [-math.inf, 1.5]


def test_one_odd_row_among_many_decides_however_rows_are_split(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id = 17777 THEN 'x' ELSE cast(id AS string) END AS x",
                                        "cast(id AS string) AS y")
    for parts in (1, 13):
        assert infer.column_types(df.repartition(parts)) == ["string", "bigint"]


def test_written_table_comes_back_with_its_types(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, Decimal("1.50"), "a,\"b\"", dt.date(2020, 1, 1), True, ""), (2, None, None, None, False, "x")],
        "id long, `the price` decimal(9,2), name string, day date, flag boolean, note string")
    path = str(tmp_path / "t.csv")
    csv_io.write_csv(df.repartition(2), path)
    back = infer.read_typed_csv(spark, path)
    assert back.dtypes == [("id", "bigint"), ("the price", "decimal(3,2)"), ("name", "string"), ("day", "date"),
                           ("flag", "boolean"), ("note", "string")]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
