"""The true median from a distributed histogram."""

import random
import statistics
from decimal import Decimal

import pytest

from tillroll.operators import order_stats
from tillroll.operators.order_stats import exact_median


@pytest.mark.parametrize("buckets", [1, 7, 200, 20_000])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 2001])
def test_equals_the_plain_median(spark, n, buckets):
    rng = random.Random(n)
    vals = [Decimal(rng.randint(-10**9, 10**10)) / 10**6 for _ in range(n)]
    vals[: n // 4] = [Decimal("3.5")] * (n // 4)
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x decimal(24,6)")
    got = exact_median(df, "x", buckets=buckets).first()[0]
    want = float(statistics.median(vals)) if vals else None
    assert got == want or abs(got - want) < 1e-9 * max(1, abs(want))


def test_values_are_not_merged_in_one_task(spark):
    df = spark.createDataFrame([(Decimal(1),)], "x decimal(24,6)")
    plan = exact_median(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan
    assert " percentile(" not in plan
    assert exact_median(df, "x").dtypes == [("median", "double")]


@pytest.mark.parametrize("shape", ["spread", "hot", "two hot", "ends"])
@pytest.mark.parametrize("accuracy", [40, 300])
def test_repeated_enclosing_leaves_few_values_and_the_same_medians(spark, monkeypatch, shape, accuracy):
    """Small accuracy and limit: several rounds, values shared by many rows included."""
    monkeypatch.setattr(order_stats, "MOST_RANKED", 1)
    rng = random.Random(accuracy)
    vals = [Decimal(rng.randint(0, 10**7)) / 100 for _ in range(20_000)]
    if shape != "spread":
        vals[:7000] = [Decimal("50000.01")] * 7000
    if shape == "two hot":
        vals[7000:14_000] = [Decimal("50000.03")] * 7000
    if shape == "ends":
        vals[7000:] = [Decimal(rng.randint(5_000_000, 5_000_400)) / 100 for _ in range(13_000)]
    df = spark.createDataFrame([(v,) for v in vals], "x decimal(24,6)").repartition(3)
    spots = order_stats.enclosing(df.selectExpr("'x' g", "x v"), lambda n: (n // 2 - 1, n // 2), accuracy)
    n, lo, hi = spots["x"]
    inside = {v for v in vals if lo <= v <= hi}
    assert n == len(vals) and len(inside) <= 4 * accuracy + 2
    m = len(vals) // 2
    want = (sorted(vals)[m - 2] + sorted(vals)[m - 1]) / 2
    got = order_stats.lower_half_median(df, "x", buckets=accuracy, scale=6).first()[0]
    assert got == want
    assert abs(exact_median(df, "x", buckets=accuracy).first()[0] - float(statistics.median(vals))) < 1e-6
