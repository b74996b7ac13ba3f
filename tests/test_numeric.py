from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.functions.numeric import exact_mean, rounded_ratio_pct
from tillroll.operators.impute import keyed_mean


def test_mean_rounds_once(spark):
    # 20,003 rows: 20103.01 then zeros; true mean 1.00499975 -> 1.00 (not 1.01)
    df = spark.range(20003).select(
        F.when(F.col("id") == 0, F.lit(Decimal("20103.01"))).otherwise(F.lit(Decimal("0")))
        .cast("decimal(18,2)").alias("x"))
    row = df.agg(exact_mean(F.sum("x"), F.count("x"), 2).alias("m")).first()
    assert row.m == Decimal("1.00")


def test_half_away_from_zero(spark):
    df = spark.createDataFrame([("a", Decimal("-1.25")), ("a", Decimal("-1.24")),
                                ("b", Decimal("1.25")), ("b", Decimal("1.24")),
                                ("c", Decimal("0.4")), ("d", None)],
                               "k string, x decimal(18,2)")
    got = {r.k: r.mean for r in keyed_mean(df, "x", ["k"], 2).collect()}
    assert got == {"a": Decimal("-1.25"), "b": Decimal("1.25"), "c": Decimal("0.40"), "d": None}
    got0 = {r.k: r.mean for r in keyed_mean(df, "x", ["k"], 0).collect()}
    assert got0["c"] == Decimal("0") and got0["a"] == Decimal("-1")


def test_share_percent(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 2355), (1894, 2355), (172, 2355)], "c long, t long")
    got = [r.p for r in df.select(rounded_ratio_pct("c", "t").alias("p")).collect()]
    assert got == [33.33, 66.67, 0.04, 80.42, 7.3]
