from pyspark.sql import functions as F

from tillroll.operators import profile


def test_share_with_null_group_and_dedup(spark):
    rows = [("c1", "F"), ("c1", "F"), ("c2", "M"), ("c3", " "), ("c4", None), (None, "F")]
    df = spark.createDataFrame(rows, "customer_id string, gender string")
    got = {r.gender: (r.gender_count, r.gender_percent)
           for r in profile.share(df, "gender", ["customer_id"]).collect()}
    # 5 distinct (customer, gender) rows; the NULL group counts 0 but is in the total
    assert got == {"F": (2, 40.0), "M": (1, 20.0), " ": (1, 20.0), None: (0, 0.0)}


def test_mean_by_distinct_rows(spark):
    rows = [("c1", "TX", 10.0), ("c1", "TX", 10.0), ("c2", "TX", 20.0), ("c3", "ME", 5.0)]
    df = spark.createDataFrame(rows, "customer_id string, state string, t double") \
        .withColumn("t", F.col("t").cast("decimal(18,2)"))
    got = {r.state: float(r.m) for r in profile.mean_by(
        df, "t", ["state"], ["customer_id", "state", "t"], scale=2, alias="m").collect()}
    assert got == {"TX": 15.0, "ME": 5.0}


def test_top_share_tiebreak(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "s string")
    top = profile.top_share(profile.share(df, "s"), "s", 2).collect()
    assert [r.s for r in top] == ["c", "a"]


def test_reports_equal_the_single_queries_in_one_scan(spark, tmp_path):
    rows = [("c1", "F", "TX", 30, "1.10", "r1"), ("c1", "F", "TX", 30, "1.10", "r2"), ("c2", "M", "TX", 95, "2.25", "r3"),
            ("c3", None, "ME", None, None, "r4"), (None, " ", None, 40, "0.35", "r4"), (None, " ", None, 40, "0.35", None)]
    spark.createDataFrame(rows, "customer_id string, gender string, state string, age int, t string, r string").selectExpr(
        "* EXCEPT (t)", "cast(t AS decimal(18,2)) AS total").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    R = profile.Report
    out = profile.reports(df, [
        R("g", "gender", "customer_id"), R("s", "state"), R("age", None, "customer_id", "age", F.col("age") <= 90),
        R("spend", "state", "customer_id", "total", scale=2)])
    got = {(r.report, r.value): (r.n, r.percent, r.mean) for r in out.collect()}
    for name, entity, col in (("g", ["customer_id"], "gender"), ("s", None, "state")):
        for r in profile.share(df, col, entity, "n", "p").collect():
            assert got.pop((name, r[col])) == (r.n, r.p, None)
    mean = profile.mean_by(df, "age", None, ["customer_id", "age"], F.col("age") <= 90).first()[0]
    assert got.pop(("age", None)) == (2, None, mean)
    for r in profile.mean_by(df, "total", ["state"], ["customer_id", "state", "total"], scale=2).collect():
        n, percent, m = got.pop(("spend", r.state))
        assert percent is None and (m is None) == (r["mean"] is None) and (m is None or m == float(r["mean"]))
    assert not got
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Relation [") <= 2    # the totals reuse the first exchange


def test_reports_scan_the_stored_table_once_when_run(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id % 7 AS string) AS s", "cast(id % 90 AS string) AS c").write.parquet(
        str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = profile.reports(df, [profile.Report("s", "s"), profile.Report("c", "s", "c")])
    assert out.count() == 14 and len(out.collect()) == 14
    final = out._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert final.count("Scan parquet") == 1 and "ReusedExchange" in final


def test_reports_of_an_entity_share_their_rows_and_totals_their_shuffle(spark, tmp_path):
    """A customer is one row of the first shuffle, not one per report, and no step
    before the groups runs a second time for the totals."""
    spark.range(0, 4000, 1, 1).selectExpr(
        "cast(id % 200 AS string) AS c", "cast(id % 2 AS string) AS g", "cast(id % 5 AS string) AS s",
        "cast(id % 100 AS int) AS age", "cast(id % 50 AS decimal(18,2)) AS total").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    R = profile.Report
    out = profile.reports(df, [R("g", "g", "c"), R("s", "s", "c"), R("age", "g", "c", "age", F.col("age") <= 90),
                               R("spend", "s", "c", "total", scale=2)])
    out.collect()

    def shuffles(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return shuffles(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return shuffles(plan.plan())
        here = [plan] if plan.nodeName() == "Exchange" else []
        return here + [x for k in range(plan.children().size()) for x in shuffles(plan.children().apply(k))]

    written = [x.metrics().apply("shuffleRecordsWritten").value() for x in shuffles(out._jdf.queryExecution().executedPlan())]
    # Rows of customers and of their totals, rows per report, groups, totals.
    assert max(written) < 3 * 200 and sum(n < 100 for n in written) == 2
    for name, col in (("g", "g"), ("s", "s")):
        got = {r.value: (r.n, r.percent) for r in out.where(F.col("report") == name).collect()}
        assert got == {r[col]: (r.n, r.p) for r in profile.share(df, col, ["c"], "n", "p").collect()}
