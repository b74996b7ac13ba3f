"""Stored count cube of the final table (E2-E9), kept up by batches.

Every batch of rows (a load, a day of receipts) has a table of its own counts.
Counts of disjoint rows add up, so the cube of everything is their sum, and a
batch that is written again replaces its counts instead of adding them twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators import temporal
from tillroll.sources import store


def put_batch(prepared: DataFrame, path: str, batch: str) -> None:
    """Count the rows of one batch (``temporal.prep``'s columns); atomic."""
    if not re.fullmatch("[A-Za-z0-9][A-Za-z0-9-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    store.replace_table(temporal.count_cube(prepared), f"{path}/{batch}")


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """The cube over all committed batches."""
    held = [f"{path}/{b}" for b in store.names(spark, path) if store.exists(spark, f"{path}/{b}/{store.POINTER}")]
    if not held:
        raise ValueError(f"no committed batch in {path}")
    return temporal.merged_cube(spark.read.parquet(*[store.current_version(spark, p) for p in held]))
