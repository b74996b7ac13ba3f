"""Exact k-sigma bounds against rational arithmetic."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tillroll.operators import outliers


def frame(spark, values, kind="decimal(24,6)"):
    return spark.createDataFrame([(None if v is None else Decimal(v),) for v in values], "x decimal(38,6)").select(
        F.col("x").cast(kind))


def kept(value: Decimal, values: list[Decimal], k: int) -> bool:
    """|x - mean| <= k * sd, squared, in fractions."""
    xs = [Fraction(v) for v in values]
    n, mean = len(xs), sum(xs) / len(xs)
    return (Fraction(value) - mean) ** 2 <= k * k * sum((x - mean) ** 2 for x in xs) / (n - 1)


@pytest.mark.parametrize("seed,top", [(1, 10), (2, 10 ** 6), (3, 10 ** 17)])
def test_limits_are_the_last_values_within(spark, seed, top):
    rng = random.Random(seed)
    values = [Decimal(rng.randint(-top, top * 3)).scaleb(-6) for _ in range(301)]
    df = frame(spark, [*values, None])
    low, high = outliers.sigma_limits(df, "x", 1.0)
    unit = Decimal(1).scaleb(-6)
    assert kept(low, values, 1) and kept(high, values, 1)
    assert not kept(low - unit, values, 1) and not kept(high + unit, values, 1)
    got = outliers.null_outside(df, "x", (low, high)).where("x IS NOT NULL").count()
    assert got == sum(kept(v, values, 1) for v in values)


def test_a_value_on_a_bound_stays_however_rows_are_split(spark):
    # mean 0.2, deviation 0.1: both ends lie on the bounds, which doubles miss.
    df = frame(spark, ["0.1", "0.2", "0.3"])
    for parts in (1, 2, 7):
        split = df.repartition(parts)
        out = outliers.remove_outliers(split, "x", 10, 1.0)
        assert out.where("x IS NULL").count() == 0
        b = outliers.sigma_bounds(split, "x", 1.0).first()
        assert (b.lower_bound, b.upper_bound) == (0.1, 0.3)


def test_sums_do_not_depend_on_the_split(spark):
    rng = random.Random(4)
    df = frame(spark, [Decimal(rng.randint(-10 ** 22, 10 ** 22)).scaleb(-6) for _ in range(500)])
    seen = {outliers.moments(df.repartition(p), "x") for p in (1, 3, 16)}
    assert len(seen) == 1
    xs = [int(r.x.scaleb(6)) for r in df.collect()]
    one = seen.pop()
    assert (one.n, one.total, one.squares) == (500, sum(xs), sum(x * x for x in xs))


def test_few_values_doubles_and_integers(spark):
    assert outliers.sigma_limits(frame(spark, ["5", None]), "x") is None
    assert outliers.sigma_limits(frame(spark, []), "x") is None
    b = outliers.sigma_bounds(frame(spark, ["5"]), "x").first()
    assert b.lower_bound is None and b.upper_bound is None
    assert outliers.sigma_limits(frame(spark, ["7", "7"]), "x", 3.0) == (Decimal(7), Decimal(7))
    ints = spark.createDataFrame([(1,), (2,), (3,)], "x long")
    assert outliers.sigma_limits(ints, "x", 1.0) == (Decimal(1), Decimal(3))
    floats = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (900.0,)], "x double")
    out = outliers.remove_outliers(floats, "x", 100.0, 3.0)
    assert sorted(r.x for r in out.collect() if r.x is not None) == [1.0, 2.0, 3.0]
