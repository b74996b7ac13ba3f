"""Plan-shape checks: the physical plans we want at scale."""

import itertools
import re

from tillroll.operators import impute
from tillroll.plans import catalog, pipeline
from tillroll.sources import store

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_final_output_has_no_cartesian_or_nested_loop(spark):
    txt = plan_text(catalog.REGISTRY["final_output"](spark, SF))
    assert "CartesianProduct" not in txt
    assert "BroadcastNestedLoopJoin" not in txt


def test_impute_uses_aggregates_not_row_windows(spark):
    txt = plan_text(catalog.REGISTRY["impute_price"](spark, SF))
    assert "Window" not in txt and "Aggregate" not in txt       # the group sums are stored
    c, p = catalog._cleaned(spark, SF), catalog.PARAMS
    sums = plan_text(impute.level_stats(pipeline.stored_items(c), p.item_levels, pipeline.item_targets(c, p)))
    assert "Window" not in sums and "HashAggregate" in sums and sums.count("Scan parquet") == 1


def test_scan_prunes_columns_and_pushes_filters(spark):
    txt = plan_text(catalog.REGISTRY["median_qty"](spark, SF))
    scan = next(line for line in txt.split("\n") if "Scan parquet" in line)
    assert re.search(r"\[quantity#\d+\]", scan) and "DataFilters" in scan and "(quantity#" in scan
    assert "GreaterThan(quantity," in catalog.REGISTRY["median_qty"](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_medians_join_nothing_and_rank_after_an_enclosing_filter(spark):
    for name in ("median_price", "median_qty", "median_total", "median_exact"):
        df = catalog.REGISTRY[name](spark, SF)
        txt = plan_text(df)
        assert "Join" not in txt and "TakeOrderedAndProject" not in txt
        # What one task ranks are counted values of the enclosing interval,
        # MOST_RANKED at most (tests/test_median_plan.py), not rows.
        below = txt.split("SinglePartition")[1] if "SinglePartition" in txt else txt
        assert "hashpartitioning" in below and "partial_count(1)" in below


def large_joins(df) -> int:
    """Sort-merge joins that ran; a reused exchange hides what it stands for."""
    df.collect()
    final = plan_text(df).split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    return final.count("SortMergeJoin")


def executed(df) -> str:
    df.collect()
    return plan_text(df).split("== Initial Plan ==")[0]


def test_joins_move_what_they_must(spark):
    """With broadcasts off: J1 moves nothing (both sides are bucketed by the item),
    J2 moves the items once; the stored rows meet J3 as they lie, and only the
    incomplete ones are dealt for a lookup per level and the brands."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = executed(catalog.REGISTRY["items_joined"](spark, SF))
        assert joined.count("SortMergeJoin") == 2
        first = joined[joined.rindex("SortMergeJoin"):]
        assert "receipt_item_id" in first.split("\n")[0] and "Exchange" not in first
        assert large_joins(catalog.REGISTRY["impute_price"](spark, SF)) <= 3     # fewer where a level has no rows left
        # J3 for complete and for incomplete rows, three lookups, J6.
        final = catalog.REGISTRY["final_output"](spark, SF)
        assert large_joins(final) <= 6
        lines = executed(final).split("\n")
        meets = [i for i, line in enumerate(lines) if "SortMergeJoin [receipt_id#" in line]
        assert len(meets) == 2
        for i in meets:
            deep = lines[i].index("+-") if "+-" in lines[i] else lines[i].index(":-")
            below = itertools.takewhile(lambda x: re.match(r"[ :]*", x).end() > deep, lines[i + 1:])
            assert not [x for x in below if "Exchange" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_incomplete_rows_are_read_from_their_own_folder(spark):
    txt = plan_text(catalog.REGISTRY["impute_price"](spark, SF))
    assert txt.count("PartitionFilters: [isnotnull(incomplete") == 2


def test_share_reads_the_final_table_once(spark):
    txt = plan_text(catalog.REGISTRY["share_brand"](spark, SF))
    assert txt.count("Scan parquet") == 1


def test_fills_meet_the_stored_rows_as_they_lie(spark):
    """With broadcasts off the incomplete rows move for no fill, with or without the receipts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in executed(catalog.REGISTRY["impute_price"](spark, SF))
        final = executed(catalog.REGISTRY["final_output"](spark, SF))
        assert final.count("SortMergeJoin") >= 3 and not re.search(r"hashpartitioning\([^)]*__row", final)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_complete_receipts_stay_in_their_buckets(spark):
    """Receipts with a total are not dealt again (the rows stay the same), and each
    bucket of the wide receipts is one file, so no task writes the rows of many."""
    c, p = catalog._cleaned(spark, SF), catalog.PARAMS
    got = pipeline.receipts_imputed(c, p, lies_by="id")
    assert got.exceptAll(pipeline.receipts_imputed(c, p)).isEmpty()
    catalog.REGISTRY["final_output"](spark, SF)
    folders = [n for n in store.names(spark, store.scratch(spark)) if n.startswith("wide-receipts")]
    assert folders and spark.conf.get(store.AUTO_SCAN) == "true"
    for folder in folders:
        files = [n for n in store.names(spark, f"{store.scratch(spark)}/{folder}") if n.startswith("part-")]
        assert 0 < len(files) <= store.buckets(spark)
