"""Joins and the final wide table.

Join order is chosen for shuffles, not copied from the reference text:

* J1 (items x details on receipt_item_id) and J2 (x receipts on receipt_id)
  are large x large inner joins (sort-merge unless AQE finds a small side).
* J3 (x new_receipts on the same receipt_id) meets the stored J2 rows, which are
  bucketed by receipt_id, so the item side is not shuffled again. The group
  means are taken over the J2 rows by an aggregate of their own, so duplicate
  receipt ids, which fan J3 out, leave them alone. Receipts without id can
  match nothing and stay out.
* J4 (customers) and J5 (retailers) are keyed on receipt columns, so they
  are applied to the receipt table before J3 - left joins are associative
  here because their conditions only read receipt and dimension columns.
  The item side never moves for them.
* J6 (brands) is keyed on an item column and joins last; a small brand table
  is broadcast by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.timecols import completed_years, wallclock_at_offset

# Output columns of the final table, in the reference's order (fixed values).
FINAL_COLUMNS = [
    "customer_id", "gender", "age", "education", "state", "retailer_id", "retailer_type",
    "receipt_id", "total_price", "created_at_mst", "receipt_item_id", "primary_category_id",
    "secondary_category_id", "tertiary_category_id", "brand_name", "global_product_id",
    "price", "quantity", "flag_price_imputed", "flag_qty_imputed",
]

ITEM_COLUMNS = ["receipt_id", "receipt_item_id", "global_product_id", "retailer_id", "brand_id",
                "primary_category_id", "secondary_category_id", "tertiary_category_id",
                "price", "quantity"]


def join_items(items: DataFrame, details: DataFrame, receipts: DataFrame) -> DataFrame:
    """J1 + J2: the joined item rows the item means are computed over.

    Items without details or without a receipt are dropped (inner joins).
    """
    d = details.select("receipt_item_id", "receipt_id", "primary_category_id",
                       "secondary_category_id", "tertiary_category_id", "brand_id",
                       "global_product_id")
    r = receipts.select(F.col("id").alias("receipt_id"), "retailer_id")
    s = items.select("receipt_item_id", "price", "quantity").join(d, "receipt_item_id")
    return s.join(r, "receipt_id").select(*ITEM_COLUMNS)


def receipt_side(new_receipts: DataFrame, customers: DataFrame, retailers: DataFrame,
                 as_of: str, zone: str = "-07:00") -> DataFrame:
    """new_receipts left-joined to customers (J4) and retailers (J5), with the
    receipt-level output columns computed (F2 age, F3 wall-clock time)."""
    c = customers.select(F.col("id").alias("__cid"), "gender", "birth_date", "education", "state")
    rt = retailers.select(F.col("id").alias("__rid"), "retailer_type")
    nr = new_receipts.select(
        F.col("id").alias("__nr_id"), "customer_id", F.col("retailer_id").alias("__nr_retailer"),
        F.col("imputed_total_price").alias("total_price"), "created_at").where("__nr_id IS NOT NULL")
    out = (nr.join(c, nr.customer_id == c.__cid, "left")
             .join(rt, F.col("__nr_retailer") == rt.__rid, "left"))
    return out.select(
        "__nr_id",
        F.col("__cid").alias("customer_id"), "gender",
        completed_years("birth_date", as_of).alias("age"), "education", "state",
        F.col("__nr_retailer").alias("nr_retailer_id"), "retailer_type", "total_price",
        wallclock_at_offset("created_at", zone).alias("created_at_mst"))


def attach_receipts(joined_items: DataFrame, receipts_wide: DataFrame) -> DataFrame:
    """Every joined item row meets every receipt row with its id (left)."""
    return joined_items.join(receipts_wide, F.col("receipt_id") == F.col("__nr_id"), "left")


def finish(items_wide: DataFrame, brands: DataFrame) -> DataFrame:
    """J6 + projection to the 20 final columns."""
    b = brands.select(F.col("id").alias("__bid"), F.col("name").alias("brand_name"))
    out = items_wide.join(b, items_wide.brand_id == b.__bid, "left")
    return out.select(
        "customer_id", "gender", "age", "education", "state",
        F.col("nr_retailer_id").alias("retailer_id"), "retailer_type",
        F.col("__nr_id").alias("receipt_id"), "total_price", "created_at_mst",
        "receipt_item_id", "primary_category_id", "secondary_category_id",
        "tertiary_category_id", "brand_name", "global_product_id",
        F.col("imputed_price").alias("price"), F.col("imputed_quantity").alias("quantity"),
        "flag_price_imputed", "flag_qty_imputed")
