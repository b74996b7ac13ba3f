import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators.order_stats import exact_median, lower_half_median, top_k


def brute(values, scale=2):
    """The reference's lower-half median, literally."""
    xs = sorted(values)
    m = len(xs) // 2
    picked = sorted(xs[:m], reverse=True)[:2]
    if not picked:
        return None
    mean = sum(picked) / len(picked)
    q = Decimal(1).scaleb(-scale)
    from decimal import ROUND_HALF_UP
    return Decimal(mean).quantize(q, rounding=ROUND_HALF_UP)


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x decimal(18,2)")


@pytest.mark.parametrize("vals,expect", [
    ([], None), ([Decimal("5")], None), ([Decimal("1"), Decimal("9")], Decimal("1.00")),
    ([Decimal("3"), Decimal("1"), Decimal("2")], Decimal("1.00")),
    ([Decimal("1"), Decimal("2"), Decimal("3"), Decimal("4")], Decimal("1.50")),
    ([Decimal("5"), Decimal("4"), Decimal("3"), Decimal("2"), Decimal("1")], Decimal("1.50")),
])
def test_small_n(spark, vals, expect):
    got = lower_half_median(frame(spark, vals), "x").first()[0]
    assert got == expect


@pytest.mark.parametrize("buckets", [1, 2, 7, 4096])
def test_matches_brute_force(spark, buckets):
    rng = random.Random(buckets)
    vals = [Decimal(rng.randint(-500, 5000)) / 100 for _ in range(3000)]
    vals += [Decimal("12.34")] * 400          # a hot value
    got = lower_half_median(frame(spark, vals), "x", buckets=buckets).first()[0]
    assert got == brute(vals)


def test_filter_zero_and_null(spark):
    vals = [Decimal("0"), None, Decimal("-1.25"), Decimal("7"), Decimal("9"), Decimal("0")]
    df = frame(spark, vals)
    got = lower_half_median(df, "x", F.col("x") != 0).first()[0]
    assert got == brute([Decimal("-1.25"), Decimal("7"), Decimal("9")])
    gotq = lower_half_median(df, "x", F.col("x") > 0, scale=0).first()[0]
    assert gotq == Decimal("7")    # n=2 -> x[1]


def test_exact_median(spark):
    df = frame(spark, [Decimal(v) for v in (1, 2, 3, 4)])
    assert float(exact_median(df, "x").first()[0]) == 2.5


def test_top_k_nulls_first_and_tiebreak(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("d", None)], "k string, v int")
    got = [r.k for r in top_k(df, "v", 3, ["k"]).collect()]
    assert got == ["d", "b", "c"]


def test_grouped_series_with_own_scales(spark):
    from tillroll.operators.order_stats import lower_half_medians
    rng = random.Random(11)
    a = [Decimal(rng.randint(1, 90000)) / 100 for _ in range(501)]
    b = [Decimal(rng.randint(1, 5000)) / 100 for _ in range(64)]
    rows = [("a", v) for v in a] + [("b", v) for v in b] + [("c", Decimal("3"))]
    df = spark.createDataFrame(rows, "g string, v decimal(18,2)")
    got = {r.g: r.median for r in lower_half_medians(df, {"a": 2, "b": 0}).collect()}
    assert got["a"] == brute(a, 2)
    assert got["b"] == brute(b, 0)
    assert got.get("c") is None            # one value: no rank qualifies


def test_one_huge_value_leaves_the_ranked_rows_few(spark):
    """Distinct values are ranked only near the middle, however they are spread."""
    n = 200_000
    df = spark.range(n).select((F.col("id") + 1).cast("decimal(24,6)").alias("x")).unionByName(
        spark.range(1).select(F.lit(10 ** 12).cast("decimal(24,6)").alias("x")))
    got = lower_half_median(df, "x", buckets=2000)
    assert got.first()[0] == Decimal(n // 2) - Decimal("0.5")
    plan = got._jdf.queryExecution()
    got.collect()
    text = plan.executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    sizes = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name == "Window":
            sizes.append(node.child())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    walk(plan.executedPlan())
    assert sizes
    lo, hi = n // 2 - 3 * (n // 2000) * 2, n // 2 + 3 * (n // 2000) * 2
    ranked = df.where((F.col("x") >= lo) & (F.col("x") <= hi)).count()
    assert ranked < n // 100


def test_exact_median_in_registry(spark):
    from tillroll.plans import catalog
    assert catalog.REGISTRY["median_exact"](spark, "/root/testdata/sf0.001").count() == 1
