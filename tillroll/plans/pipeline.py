"""The staged batch pipeline (P1, P2) as one lazy Spark plan.

load -> clean (C1-C4) -> caps (C5) -> k-sigma (C6) -> medians (M1, M2) ->
joined items (J1, J2) -> item imputation (I1, I2) -> receipt median (M3) ->
receipt imputation (I3) -> final table (J3-J6).

J1 and J2 run once: the joined rows are stored, bucketed by receipt and tagged
with whether a value is missing. The group sums of all levels are one aggregate of
them, J3 meets them without a shuffle of the items, and only incomplete rows look
up means: their keys travel for it, and the fills come back to the rows' buckets. The
plan is the same at every size.

``run`` commits its stages (cleaned tables, joined rows, group sums, fills, wide
receipts) under the shared checkpoint folder: that cuts the lineage (an executor
lost later recomputes from the written stage, not from the raw scans), and a run
that failed is continued by the next one with the same inputs and parameters
(``store.Stages``). The folder is deleted when the final table is written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.numeric import DEC
from tillroll.functions.scalars import literal, one_row
from tillroll.operators import clean, enrich, impute, order_stats, outliers
from tillroll.session import ensure_checkpoint_dir
from tillroll.sources import csv_io, fixtures, store
from tillroll.sources.schemas import RAW


@dataclass(frozen=True)
class Params:
    """Pipeline parameters; defaults are the reference's own values."""
    price_cap: float = 10000
    total_cap: float = 100000
    k_sigma: float = 3.0
    as_of: str = "2017-09-01"
    zone: str = "-07:00"
    price_scale: int = 2
    qty_scale: int = 0
    clean: bool = True
    item_levels: list = field(default_factory=lambda: [
        ["global_product_id"], ["primary_category_id", "secondary_category_id"],
        ["retailer_id", "brand_id"]])
    item_level_names: list = field(default_factory=lambda: [
        "product", "category", "retailer_brand"])
    receipt_levels: list = field(default_factory=lambda: [
        ["customer_id", "retailer_id"], ["retailer_id"]])
    receipt_level_names: list = field(default_factory=lambda: [
        "customer_retailer", "retailer"])


# Parameters for the driver fixtures: the reference's caps would null most of
# the TPC-H-scale prices, so FIXTURES.md raises them.
FIXTURE_PARAMS = Params(price_cap=fixtures.PRICE_CAP, total_cap=fixtures.TOTAL_CAP,
                        as_of=fixtures.AS_OF)


TABLES = ("receipts", "customers", "retailers", "brands", "details", "items")


class Inputs:
    """The six receipt tables a pipeline reads, typed (C4 applied) but not yet
    cleaned. A table may be given as a function; it is called on first use."""

    def __init__(self, receipts, customers, retailers, brands, details, items):
        self._given = {"receipts": receipts, "customers": customers, "retailers": retailers,
                       "brands": brands, "details": details, "items": items}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._given:
            raise AttributeError(name)
        value = self._given[name]
        if not isinstance(value, DataFrame):
            value = self._given[name] = value()
        return value

    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str) -> "Inputs":
        t = fixtures.Tables(spark, sf_dir)
        return cls(t.receipts, t.customers, t.retailers, t.brands, t.receipt_item_details,
                   t.receipt_items)

    @classmethod
    def from_csv(cls, spark: SparkSession, csv_dir: str, lenient: bool = False,
                 multi_line: bool = False) -> "Inputs":
        """S1 + C1 + C4 + C8: ``<csv_dir>/<table>.csv`` (file or folder of parts),
        header, comma, declared all-string schema; sentinels to NULL, strict
        numeric casts (``lenient`` turns malformed numbers into NULL), typed
        dates and timestamps, ``char(n)`` padding."""
        def read(name: str) -> DataFrame:
            return csv_io.read_csv(spark, f"{csv_dir.rstrip('/')}/{name}.csv", RAW[name], multi_line)
        return cls(lambda: clean.clean_receipts(read("receipts"), lenient),
                   lambda: clean.pad_declared(read("customers").withColumn(
                       "birth_date", F.col("birth_date").cast("date")), "customers"),
                   lambda: read("retailers"), lambda: read("brands"),
                   lambda: clean.clean_details(read("receipt_item_details")),
                   lambda: clean.clean_items(read("receipt_items"), lenient))


class Cleaned:
    """The tables after C1-C6. Each is cleaned on first use, so a query that
    reads receipts only computes no bounds of the items."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]], stored: Callable | None = None):
        self._makers, self._memo = makers, {}
        self._stored = stored or (lambda name, make, **how: store.keep(make(), name, **how))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._makers:
            raise AttributeError(name)
        return self.memo(f"table:{name}", self._makers[name])

    def memo(self, key: str, make):
        """Evaluate a table or global value (bound, median) once per cleaned input."""
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]

    def stored(self, name: str, make: Callable[[], DataFrame], bucket: str | None = None,
               tag: str | None = None, row: str | None = None) -> DataFrame:
        """A stored intermediate table, computed once per cleaned input."""
        return self.memo(f"stored:{name}", lambda: self._stored(name, make, bucket=bucket, tag=tag, row=row))

    def staged(self, **buckets: str) -> "Cleaned":
        """The same with some tables stored, each bucketed by the column given."""
        return Cleaned({k: (lambda k=k: self.stored(k, lambda: getattr(self, k), buckets[k]) if k in buckets
                            else getattr(self, k)) for k in self._makers}, self._stored)


def clean_stage(inp: Inputs, p: Params, stored: Callable | None = None) -> Cleaned:
    """C1-C6 on every table (P2: switchable, the reference's script assumes it done).
    ``stored(name, make, bucket=, tag=, row=)`` keeps intermediate tables."""
    if not p.clean:
        return Cleaned({k: (lambda k=k: getattr(inp, k)) for k in TABLES}, stored)
    return Cleaned({
        "items": lambda: outliers.remove_outliers(inp.items, "price", p.price_cap, p.k_sigma),
        "receipts": lambda: outliers.remove_outliers(inp.receipts, "total_price", p.total_cap, p.k_sigma),
        "customers": lambda: clean.clean_customers(inp.customers),
        "brands": lambda: clean.clean_brands(inp.brands),
        "retailers": lambda: inp.retailers,
        "details": lambda: inp.details,
    }, stored)


def median_price(items: DataFrame, p: Params) -> DataFrame:
    """M1: lower-half median of non-zero prices, 2 places."""
    return order_stats.lower_half_median(items, "price", F.col("price") != 0,
                                         p.price_scale, alias="median_price")


def median_qty(items: DataFrame, p: Params) -> DataFrame:
    """M2: lower-half median of positive quantities, 0 places."""
    return order_stats.lower_half_median(items, "quantity", F.col("quantity") > 0,
                                         p.qty_scale, alias="median_qty")


def median_total(receipts: DataFrame, p: Params) -> DataFrame:
    """M3: lower-half median of non-zero receipt totals, 2 places."""
    return order_stats.lower_half_median(receipts, "total_price", F.col("total_price") != 0,
                                         p.price_scale, alias="median_total_price")


def fallback(median: DataFrame) -> "F.Column":
    """A one-row median as a literal (evaluated once, see functions.scalars)."""
    return literal(one_row(median)[0], DEC)


MEDIAN_SERIES = ("price", "quantity", "total_price")


def all_medians(c: Cleaned, p: Params, wanted=MEDIAN_SERIES) -> dict:
    """M1 (price), M2 (quantity), M3 (total_price) as literals.

    The series not yet known are computed together in one job (a grouped
    lower-half median); only their result rows reach the driver (see
    functions.scalars). Known ones are reused.
    """
    todo = [g for g in wanted if f"median:{g}" not in c._memo]
    if todo:
        parts = {
            "price": lambda: c.items.where(F.col("price") != 0)
            .select(F.lit("price").alias("g"), F.col("price").alias("v")),
            "quantity": lambda: c.items.where(F.col("quantity") > 0)
            .select(F.lit("quantity").alias("g"), F.col("quantity").alias("v")),
            "total_price": lambda: c.receipts.where(F.col("total_price") != 0)
            .select(F.lit("total_price").alias("g"), F.col("total_price").alias("v")),
        }
        vals = parts[todo[0]]()
        for g in todo[1:]:
            vals = vals.unionByName(parts[g]())
        scales = {"price": p.price_scale, "quantity": p.qty_scale, "total_price": p.price_scale}
        got = {r["g"]: r["median"] for r in order_stats.lower_half_medians(
            vals, {g: scales[g] for g in todo}).collect()}
        for g in todo:
            c._memo[f"median:{g}"] = literal(got.get(g), DEC)
    return {g: c._memo[f"median:{g}"] for g in wanted}


def impute_receipts(receipts: DataFrame, p: Params, level_col: str | None = None,
                    fb=None, stored: Callable | None = None, lies_by: str | None = None) -> DataFrame:
    """Receipts.* + imputed_total_price + flag_total_price_imputed."""
    fb = fallback(median_total(receipts, p)) if fb is None else fb
    t = impute.Target("total_price", p.price_scale, "imputed_total_price", fb,
                      flag="flag_total_price_imputed", level_col=level_col)
    return impute.hierarchical_impute(receipts, [t], p.receipt_levels, p.receipt_level_names, stored=stored,
                                      lies_by=lies_by)


def item_targets(c: Cleaned, p: Params, levels: bool = False) -> list[impute.Target]:
    meds = all_medians(c, p, ("price", "quantity"))
    mp, mq = meds["price"], meds["quantity"]
    return [
        impute.Target("price", p.price_scale, "imputed_price", mp,
                      flag="flag_price_imputed", level_col="price_level" if levels else None),
        impute.Target("quantity", p.qty_scale, "imputed_quantity", mq,
                      flag="flag_qty_imputed", level_col="qty_level" if levels else None),
    ]


def joined_items(c: Cleaned) -> DataFrame:
    """J1 + J2."""
    return enrich.join_items(c.items, c.details, c.receipts)


INCOMPLETE, ROW = "incomplete", "__row"


def stored_items(c: Cleaned) -> DataFrame:
    """J1 + J2 as a stored table: bucketed by receipt, so that J3 moves no item
    row, and partitioned by ``INCOMPLETE`` (price or quantity missing), whose rows
    are numbered (``ROW``)."""
    return c.stored("joined-items", lambda: joined_items(c).withColumn(
        INCOMPLETE, impute.missing("price") | impute.missing("quantity")), "receipt_id", INCOMPLETE, ROW)


def receipts_imputed(c: Cleaned, p: Params, level_col: str | None = None, lies_by: str | None = None) -> DataFrame:
    return impute_receipts(c.receipts, p, level_col, all_medians(c, p, ("total_price",))["total_price"],
                           lambda df: c.stored("receipt-levels", lambda: df), lies_by)


def _imputed(c: Cleaned, p: Params, rows: DataFrame, levels: bool) -> DataFrame:
    return impute.hierarchical_impute(
        rows, item_targets(c, p, levels), p.item_levels, p.item_level_names, stored_items(c),
        lambda df: c.stored("item-levels", lambda: df), INCOMPLETE, [ROW, "receipt_id"],
        lambda make: c.stored("item-fills", make, "receipt_id"))


def impute_items(c: Cleaned, p: Params, levels: bool = False) -> DataFrame:
    """I1 + I2 (+ I4 flags): new_receipt_items over the stored joined rows."""
    return _imputed(c, p, stored_items(c), levels)


def final_output(c: Cleaned, p: Params) -> DataFrame:
    """The 20-column final table.

    The wide receipts (J4, J5, I3) are stored in the items' buckets, so J3 runs
    bucket by bucket without a shuffle, for complete and incomplete rows alike.
    """
    all_medians(c, p)          # the three medians in the same jobs
    wide = c.stored("wide-receipts", lambda: enrich.receipt_side(
        receipts_imputed(c, p, lies_by="id"), c.customers, c.retailers, p.as_of, p.zone), "__nr_id")
    return enrich.finish(_imputed(c, p, enrich.attach_receipts(stored_items(c), wide), False), c.brands)


def run(spark: SparkSession, src: Inputs, out: str, p: Params = Params(),
        stage: bool = True, csv_out: str | None = None) -> DataFrame:
    """Clean, impute and write the final table to ``out``, which is replaced
    whole (read it with ``csv_io.read_table``).

    With ``stage`` the cleaned receipts, items and details are stored too, in
    buckets of their join keys. Stages are committed under a digest of the input
    files, what is read from them and the parameters; if a run fails, the next one
    with the same digest goes on at the first stage that is missing. Inputs
    that are not read from files have no digest and always start anew.
    """
    digest = store.input_digest({k: getattr(src, k) for k in TABLES})
    key = hashlib.sha256(f"{digest or uuid.uuid4().hex}|{p}|{stage}".encode()).hexdigest()[:32]
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    stages = store.Stages(spark, f"{base.rstrip('/')}/tillroll-run-{key}", key)
    try:
        c = clean_stage(src, p, stages.get)
        if stage:
            c = c.staged(receipts="id", items="receipt_item_id", details="receipt_item_id")
        csv_io.write_table(final_output(c, p), out)
    except Exception:
        if digest is None:
            stages.drop()
        raise
    stages.drop()
    result = csv_io.read_table(spark, out)
    if csv_out:
        csv_io.write_csv(result, csv_out)
    return result
