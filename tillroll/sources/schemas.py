"""Declared input schemas of the seven receipt-model tables.

Raw CSV columns are all read as strings (so sentinel tokens survive the scan),
then cleaned and cast.
"""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

_S = StringType()


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, _S, True) for n in names])


# Column lists in declared order (fixed values).
RAW = {
    "receipts": _strings("id", "customer_id", "retailer_id", "created_at", "total_price"),
    "customers": _strings("id", "gender", "birth_date", "education", "state"),
    "retailers": _strings("id", "retailer_type"),
    "brands": _strings("id", "name"),
    "product_categories": _strings("id", "name"),
    "receipt_item_details": _strings(
        "receipt_item_id", "receipt_id", "primary_category_id", "secondary_category_id",
        "tertiary_category_id", "brand_id", "global_product_id"),
    "receipt_items": _strings("receipt_item_id", "price", "quantity"),
}

# Sentinel-bearing columns per table (C1) and the char(n) widths.
SENTINEL_COLUMNS = {
    "receipts": ["total_price"],
    "receipt_item_details": ["primary_category_id", "secondary_category_id",
                             "tertiary_category_id", "brand_id"],
    "receipt_items": ["price", "quantity"],
}
CHAR_WIDTHS = {"customers": {"gender": 1, "state": 2}}
