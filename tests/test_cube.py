"""The count cube against counts of the rows themselves."""

import pytest
from pyspark.sql import functions as F

from tillroll.operators import temporal
from tillroll.plans import cube


@pytest.fixture(scope="module")
def rows(spark):
    return temporal.with_time_parts(spark.range(3000).selectExpr(
        "id", "timestamp'2020-08-25 00:00:00' + make_dt_interval(cast(id % 40 AS int), cast(id % 24 AS int)) "
        "AS created_at_mst", "CASE WHEN id % 5 < 4 THEN concat('s', id % 5) END AS state",
        "CASE WHEN id % 7 < 6 THEN concat('t', id % 3) END AS retailer_type",
        "CASE WHEN id % 11 > 0 THEN cast(id AS string) END AS receipt_id"))


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("state,kind", [(None, None), ("s1", None), ("s2", "t1"), ("none", None)])
def test_every_count_comes_from_the_cube(rows, state, kind):
    held = temporal.cube_rows(temporal.count_cube(rows))
    a, b = (temporal.filter_optional(x, state, kind) for x in (rows, held))
    same(temporal.daily_counts(a), temporal.daily_counts(b, count="n"))
    same(temporal.weekpart_daily(a), temporal.weekpart_daily(b, count="n_known"))
    same(temporal.hour_counts(a), temporal.hour_counts(b, count="n"))


def test_batches_add_up_and_a_repeated_batch_replaces_itself(spark, rows, tmp_path):
    path = str(tmp_path / "cube")
    for part in range(3):
        cube.put_batch(rows.where(F.col("id") % 3 == part), path, f"b{part}")
    same(cube.read_cube(spark, path), temporal.count_cube(rows))
    cube.put_batch(rows.where("id % 3 = 1"), path, "b1")
    same(cube.read_cube(spark, path), temporal.count_cube(rows))


def test_a_batch_that_fails_leaves_the_cube(spark, rows, tmp_path):
    path = str(tmp_path / "cube")
    cube.put_batch(rows, path, "all")
    broken = rows.withColumn("hour", F.raise_error(F.lit("lost")).cast("long"))
    for batch in ("all", "next"):
        with pytest.raises(Exception, match="lost"):
            cube.put_batch(broken, path, batch)
    same(cube.read_cube(spark, path), temporal.count_cube(rows))
    with pytest.raises(ValueError):
        cube.put_batch(rows, path, "../x")
    with pytest.raises(ValueError):
        cube.read_cube(spark, str(tmp_path / "none"))


def test_purchase_queries_scan_the_cube_only(spark):
    from tillroll.plans import catalog
    sf = "/root/testdata/sf0.001"
    catalog.REGISTRY["daily_counts"](spark, sf).count()     # stores it
    for name in ("daily_counts", "daily_counts_filtered", "weekpart_daily", "hour_counts_filtered", "hour_box_final"):
        plan = catalog.REGISTRY[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "n_known" in plan and "receipt_item_id" not in plan
