import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import impute
from tillroll.operators.impute import Target, hierarchical_impute, level_stats

SCHEMA = "id int, a string, b string, x decimal(18,2)"


def run(spark, rows, scale=2, fallback=Decimal("99")):
    df = spark.createDataFrame(rows, SCHEMA)
    t = Target("x", scale, "ix", F.lit(fallback).cast("decimal(18,2)"), flag="fl", level_col="lv")
    out = hierarchical_impute(df, [t], [["a"], ["b"]], ["by_a", "by_b"])
    return {r.id: (r.ix, r.fl, r.lv) for r in out.collect()}


@pytest.mark.parametrize("heavy", [1, 4, 1000])
def test_fall_through_rules(spark, monkeypatch, heavy):
    """With no group heavy, some and all."""
    monkeypatch.setattr(impute, "HEAVY_KEYS", heavy)
    rows = [
        (1, "p", "q", None), (2, "p", "q", Decimal("4")),          # level a mean 4 -> 1 gets 4
        (3, "n", "q", None), (4, "n", "q", None),                   # a all NULL -> level b
        (5, "z", "w", Decimal("0")), (6, "z", "w", Decimal("0")),   # a mean 0, b mean 0 -> fallback
        (7, "t", "v", Decimal("0.01")), (8, "t", "v", Decimal("0")),  # mean 0.005 -> 0.01 usable
        (9, "u", "s", Decimal("0.01")), (10, "u", "s", None),       # mean (0.01 + 0 + 0) / 3 -> 0.00
        (14, "u", "s", Decimal("0")), (15, "u", "s", Decimal("0")),
        (11, None, "k", Decimal("6")), (12, None, "k", None),       # NULL key is a group
        (13, "m", "r", Decimal("-2")),                               # negative is a present value
    ]
    got = run(spark, rows)
    assert got[1] == (Decimal("4.00"), "yes", "by_a")
    assert got[2] == (Decimal("4.00"), "no", "own")
    assert got[3][2] == "by_b" and got[3][0] == Decimal("4.00")    # b='q': mean of 4
    assert got[5] == (Decimal("99.00"), "yes", "median")
    assert got[8] == (Decimal("0.01"), "yes", "by_a")
    assert got[10][2] == "median"
    assert got[12] == (Decimal("6.00"), "yes", "by_a")
    assert got[13] == (Decimal("-2.00"), "no", "own")
    assert len(got) == len(rows)


def test_quantity_scale_zero(spark):
    rows = [(1, "a", "b", Decimal("0.4")), (2, "a", "b", None), (3, "c", "b", Decimal("3"))]
    got = run(spark, rows, scale=0, fallback=Decimal("7"))
    # level a: round(0.4) = 0 unusable; level b: round((0.4 + 3) / 2) = 2
    assert got[2] == (Decimal("2.00"), "yes", "by_b")


def test_fallback_may_be_null(spark):
    df = spark.createDataFrame([(1, "a", "b", None)], SCHEMA)
    t = Target("x", 2, "ix", None, flag="fl")
    r = hierarchical_impute(df, [t], [["a"]]).first()
    assert r.ix is None and r.fl == "yes"


def random_rows(n, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choice([None, None, "p", f"p{rng.randint(0, 30)}"]), rng.choice(["q", f"q{rng.randint(0, 5)}", None]),
             rng.choice([None, Decimal(0), Decimal(rng.randint(-300, 900)) / 100])) for i in range(n)]


@pytest.mark.parametrize("heavy", [1, 10, 1000])
def test_equals_group_means_of_all_rows(spark, monkeypatch, heavy):
    monkeypatch.setattr(impute, "HEAVY_KEYS", heavy)
    rows = random_rows(800)

    def mean(key, at):
        xs = [r[3] for r in rows if r[at] == key and r[3] is not None]
        return (sum(xs) / len(xs)).quantize(Decimal("0.01"), ROUND_HALF_UP) if xs else None

    got = run(spark, rows)
    assert len(got) == len(rows)
    for i, a, b, x in rows:
        tries = [("own", x), ("by_a", mean(a, 1)), ("by_b", mean(b, 2)), ("median", Decimal(99))]
        level, value = next((lv, v) for lv, v in tries if v)
        assert got[i] == (value, "no" if x else "yes", level), (i, a, b, x)


def test_level_sums_shuffle_a_row_per_task_and_group(spark):
    """Every level combines on its own keys before the shuffle: 8 tasks with 12
    groups between the levels write 96 rows at most, however many rows there are."""
    rows = [(i, f"a{i % 8}", f"b{i % 4}", Decimal(i)) for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    df.write.format("noop").mode("overwrite").save()
    stats = level_stats(df, [["a"], ["b"]], [Target("x", 2, "ix")])
    assert stats.count() == 12
    stats.collect()

    def shuffles(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return shuffles(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return shuffles(plan.plan())
        here = [plan] if plan.nodeName() == "Exchange" else []
        return here + [x for k in range(plan.children().size()) for x in shuffles(plan.children().apply(k))]

    grouped = [x for x in shuffles(stats._jdf.queryExecution().executedPlan()) if "spark_grouping_id" in x.toString()
               and "Expand" in x.toString()]
    assert [x.metrics().apply("shuffleRecordsWritten").value() <= 8 * 12 for x in grouped] == [True]


def test_complete_rows_meet_no_lookup(spark):
    df = spark.createDataFrame(random_rows(50), SCHEMA)
    t = Target("x", 2, "ix", None)
    plan = hierarchical_impute(df, [t], [["a"], ["b"]])._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" or plan.children().apply(0).nodeName() == "Union"
    union = plan if plan.nodeName() == "Union" else plan.children().apply(0)
    done, todo = (union.children().apply(k).toString() for k in (0, 1))
    assert "Join" not in done and todo.count("Join LeftOuter") == 4


def test_only_keys_of_stored_rows_are_looked_up(spark):
    """A row is numbered once, has one row of fills at most, and the lookups read and
    move no other column of it."""
    from tillroll.plans import catalog, pipeline
    c, p = catalog._cleaned(spark, "/root/testdata/sf0.001"), catalog.PARAMS
    at, rows = [pipeline.ROW, "receipt_id"], pipeline.stored_items(c)
    todo = rows.where(pipeline.INCOMPLETE)
    assert todo.select(pipeline.ROW).distinct().count() == todo.count() > 0
    targets = pipeline.item_targets(c, p)
    stats = level_stats(rows, p.item_levels, targets).localCheckpoint()
    got = impute.fills(todo, stats, p.item_levels, targets, impute.F.lit(rows.count()), at)
    assert 0 < got.count() == got.select(*at).distinct().count() <= todo.count()
    read = [x[x.index("ReadSchema"):] for x in got._jdf.queryExecution().executedPlan().toString().split("\n")
            if "ReadSchema" in x]
    assert read and not [x for x in read if "tertiary_category_id" in x or "receipt_item_id" in x]


@pytest.mark.parametrize("run_rows", [1, 3])
def test_fills_are_the_same_in_runs_of_any_length(spark, monkeypatch, run_rows):
    """A receipt's fills in many stored rows (short runs) reach the same rows as in one."""
    from tillroll.plans import catalog

    def rows():
        df = catalog.REGISTRY["final_output"](spark, "/root/testdata/sf0.001")
        return sorted(map(repr, df.collect()))

    one = rows()
    monkeypatch.setattr(impute, "RUN_ROWS", run_rows)
    assert rows() == one
    long = [(i, f"r{i % 2}", f"k{i % 7}", None if i % 3 else Decimal(i)) for i in range(200)]
    df = spark.createDataFrame(long, "__row long, receipt string, k string, x decimal(18,2)")
    t = Target("x", 2, "ix")
    filled = df.where("x is null").selectExpr("__row", "receipt", "cast(__row as decimal(18,2)) __f_x", "0 __l_x")
    runs = impute.fill_runs(filled, [t], ["__row", "receipt"], 4)
    got = impute._with_fills(df, runs, [t], ["__row", "receipt"]).collect()
    assert len(got) == 200 and all(r["__f_x"] == (None if r.x is not None else r["__row"]) for r in got)
