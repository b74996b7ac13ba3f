"""Registered queries: one ``(spark, sf_dir) -> DataFrame`` per SURVEY §2 key.

Every query starts from the driver tables (through the fixture derivation),
so its work grows with them. Decimals leave as doubles and integral results
as bigint, so the DuckDB oracle can produce the same schema and values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tillroll.functions.timecols import completed_years, wallclock_at_offset
from tillroll.operators import clean, impute, order_stats, outliers, profile, temporal
from tillroll.plans import pipeline as P
from tillroll.sources import csv_io, fixtures, infer, store
from tillroll.sources.schemas import SENTINEL_COLUMNS

PARAMS = P.FIXTURE_PARAMS
# Filter values of the optional-filter query (fixed values of the fixture).
FILTER_STATE = "NATION_3"
FILTER_RETAILER_TYPE = "AMERICA"
TOP_STATES, TOP_BRANDS, TOP_PRICES = 5, 10, 10
BOUNDS_DIGITS = 4
FLOAT_DIGITS = 9
DENSITY_DIGITS = 12
EXPORT_CODEC = "gzip"       # of the CSV files that queries export and read again

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def doubles(df: DataFrame) -> DataFrame:
    """Decimal columns -> double at the query boundary."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


def _tables(spark: SparkSession, sf: str) -> fixtures.Tables:
    return fixtures.Tables(spark, sf)


def _cleaned(spark: SparkSession, sf: str) -> P.Cleaned:
    """The cleaned tables. The joined rows are loaded once per application and
    input files, as the tables are; all else is computed by the query."""
    def stored(name, make, bucket=None, tag=None, row=None):
        if name != "joined-items":
            return store.keep(make(), name, bucket, tag, row)
        key = f"{name}-{fixtures.fingerprint(spark, sf, fixtures.RECEIPT_SOURCES)}"
        return fixtures.loaded(spark, "joined", key, make, bucket, tag, row)

    return P.clean_stage(P.Inputs.from_fixtures(spark, sf), PARAMS, stored)


def _final(spark: SparkSession, sf: str) -> DataFrame:
    """The stored final table the profiling and temporal queries read.

    As in the reference (observations and plots read ``final_output``), the
    pipeline runs once per application and set of input files and writes the
    table to the shared checkpoint folder; the profiling queries then scan it.
    """
    return fixtures.loaded(spark, "final", _final_key(spark, sf), lambda: P.final_output(_cleaned(spark, sf), PARAMS))


def _final_key(spark: SparkSession, sf: str) -> str:
    return f"final-{fixtures.fingerprint(spark, sf, fixtures.RECEIPT_SOURCES)}"


def _final_once(spark: SparkSession, sf: str) -> DataFrame:
    """The final table for a reader that scans it once and stores its rows itself:
    the stored one if there is one, else the pipeline's rows, which are not stored."""
    if fixtures.is_loaded(spark, "final", _final_key(spark, sf)):
        return _final(spark, sf)
    return P.final_output(_cleaned(spark, sf), PARAMS)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """events as purchases: ts is the local purchase time, event_type stands
    in for retailer_type, event_id for receipt_id (FIXTURES.md)."""
    ev = _tables(spark, sf).driver("events")
    return temporal.with_time_parts(ev.select(
        F.col("event_id").cast("string").alias("receipt_id"),
        F.col("ts").alias("created_at_mst"), F.col("event_type").alias("retailer_type")))


# -- S / C: sources and cleaning ---------------------------------------------

@query("clean_sentinels")
def q_clean_sentinels(spark, sf):
    raw = fixtures.as_raw_strings(_tables(spark, sf).receipt_items(), ["price", "quantity"])
    return clean.null_if_token(raw, ["price", "quantity"])


@query("cast_numeric")
def q_cast_numeric(spark, sf):
    raw = fixtures.as_raw_strings(_tables(spark, sf).receipt_items(), ["price", "quantity"])
    return doubles(clean.clean_items(raw))


@query("clean_details")
def q_clean_details(spark, sf):
    cols = ["primary_category_id", "secondary_category_id", "tertiary_category_id", "brand_id"]
    raw = fixtures.as_raw_strings(_tables(spark, sf).receipt_item_details(), cols)
    return clean.clean_details(raw)


@query("clean_customers")
def q_clean_customers(spark, sf):
    return clean.clean_customers(_tables(spark, sf).customers())


@query("clean_brands")
def q_clean_brands(spark, sf):
    return clean.clean_brands(_tables(spark, sf).brands())


@query("extreme_price")
def q_extreme_price(spark, sf):
    items = _tables(spark, sf).receipt_items()
    return doubles(outliers.null_above(items, "price", PARAMS.price_cap)
                   .select("receipt_item_id", "price"))


@query("extreme_total")
def q_extreme_total(spark, sf):
    r = _tables(spark, sf).receipts()
    return doubles(outliers.null_above(r, "total_price", PARAMS.total_cap)
                   .select("id", "total_price"))


def _bounds(df: DataFrame, col: str, cap: float) -> DataFrame:
    b = outliers.sigma_bounds(outliers.null_above(df, col, cap), col, PARAMS.k_sigma)
    return b.select(F.round("lower_bound", BOUNDS_DIGITS).alias("lower_bound"),
                    F.round("upper_bound", BOUNDS_DIGITS).alias("upper_bound"))


@query("price_bounds")
def q_price_bounds(spark, sf):
    return _bounds(_tables(spark, sf).receipt_items(), "price", PARAMS.price_cap)


@query("total_bounds")
def q_total_bounds(spark, sf):
    return _bounds(_tables(spark, sf).receipts(), "total_price", PARAMS.total_cap)


@query("sigma_limits")
def q_sigma_limits(spark, sf):
    """The least and the greatest whole cent within the exact bounds."""
    t, out = _tables(spark, sf), []
    for target, df, cap in (("price", t.receipt_items(), PARAMS.price_cap),
                            ("total_price", t.receipts(), PARAMS.total_cap)):
        cents = outliers.null_above(df, target, cap).select(F.col(target).cast("decimal(18,2)"))
        least, greatest = outliers.sigma_limits(cents, target, PARAMS.k_sigma) or (None, None)
        kept = F.col(target).between(F.lit(least), F.lit(greatest))
        out.append(cents.agg(
            F.lit(target).alias("target"), F.lit(least).cast("double").alias("least"),
            F.lit(greatest).cast("double").alias("greatest"), F.count_if(kept).alias("n_within")))
    return out[0].unionByName(out[1])


@query("sigma_price")
def q_sigma_price(spark, sf):
    return doubles(_cleaned(spark, sf).items.select("receipt_item_id", "price"))


@query("sigma_total")
def q_sigma_total(spark, sf):
    return doubles(_cleaned(spark, sf).receipts.select("id", "total_price"))


# -- M: order statistics -----------------------------------------------------

@query("median_price")
def q_median_price(spark, sf):
    return doubles(P.median_price(_cleaned(spark, sf).items, PARAMS))


@query("median_qty")
def q_median_qty(spark, sf):
    return doubles(P.median_qty(_cleaned(spark, sf).items, PARAMS))


@query("median_total")
def q_median_total(spark, sf):
    return doubles(P.median_total(_cleaned(spark, sf).receipts, PARAMS))


@query("median_exact")
def q_median_exact(spark, sf):
    """M6: the true median of the non-zero prices."""
    return order_stats.exact_median(_cleaned(spark, sf).items, "price", F.col("price") != 0, "median_price")


@query("topk_price")
def q_topk_price(spark, sf):
    items = _cleaned(spark, sf).items.where(F.col("price").isNotNull())
    return doubles(order_stats.top_k(items, "price", TOP_PRICES, ["receipt_item_id"])
                   .select("receipt_item_id", "price"))


# -- J / W / I: joins, keyed means, imputation -------------------------------

def _joined(spark, sf) -> DataFrame:
    return P.stored_items(_cleaned(spark, sf))


@query("items_joined")
def q_items_joined(spark, sf):
    return doubles(P.joined_items(_cleaned(spark, sf)))


def _mean_query(value: str, keys: list[str], scale: int, receipts: bool = False) -> Query:
    def fn(spark, sf):
        src = _cleaned(spark, sf).receipts if receipts else _joined(spark, sf)
        return doubles(impute.keyed_mean(src, value, keys, scale, alias="mean"))
    return fn


_PROD, _CAT, _RB = ["global_product_id"], ["primary_category_id", "secondary_category_id"], \
    ["retailer_id", "brand_id"]
REGISTRY["mean_price_product"] = _mean_query("price", _PROD, 2)
REGISTRY["mean_price_category"] = _mean_query("price", _CAT, 2)
REGISTRY["mean_price_retailer_brand"] = _mean_query("price", _RB, 2)
REGISTRY["mean_qty_product"] = _mean_query("quantity", _PROD, 0)
REGISTRY["mean_qty_category"] = _mean_query("quantity", _CAT, 0)
REGISTRY["mean_qty_retailer_brand"] = _mean_query("quantity", _RB, 0)
REGISTRY["mean_total_customer_retailer"] = _mean_query(
    "total_price", ["customer_id", "retailer_id"], 2, receipts=True)
REGISTRY["mean_total_retailer"] = _mean_query("total_price", ["retailer_id"], 2, receipts=True)


def _items_imputed(spark, sf, levels=False) -> DataFrame:
    return P.impute_items(_cleaned(spark, sf), PARAMS, levels=levels)


@query("impute_price")
def q_impute_price(spark, sf):
    return doubles(_items_imputed(spark, sf).select(
        "receipt_id", "receipt_item_id", "price", "imputed_price", "flag_price_imputed"))


@query("impute_quantity")
def q_impute_quantity(spark, sf):
    return doubles(_items_imputed(spark, sf).select(
        "receipt_id", "receipt_item_id", "quantity", "imputed_quantity", "flag_qty_imputed"))


@query("impute_total")
def q_impute_total(spark, sf):
    nr = P.receipts_imputed(_cleaned(spark, sf), PARAMS)
    return doubles(nr.select("id", "customer_id", "retailer_id", "total_price",
                             "imputed_total_price", "flag_total_price_imputed"))


@query("imputation_flags")
def q_imputation_flags(spark, sf):
    return (_items_imputed(spark, sf)
            .groupBy("flag_price_imputed", "flag_qty_imputed")
            .agg(F.count(F.lit(1)).alias("n")))


@query("imputation_levels")
def q_imputation_levels(spark, sf):
    c = _cleaned(spark, sf)
    # One aggregate over the imputed items serves both of their targets.
    items = P.impute_items(c, PARAMS, levels=True).groupBy("price_level", "qty_level").agg(
        F.count(F.lit(1)).alias("n"))
    pairs = F.array(F.struct(F.lit("price").alias("target"), F.col("price_level").alias("level")),
                    F.struct(F.lit("quantity").alias("target"), F.col("qty_level").alias("level")))
    items = items.select("n", F.inline(pairs)).groupBy("target", "level").agg(F.sum("n").alias("n"))
    nr = P.receipts_imputed(c, PARAMS, level_col="total_level").groupBy(
        F.lit("total_price").alias("target"), F.col("total_level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"))
    return items.unionByName(nr)


# -- S4 / F: final table and its scalar functions ----------------------------

@query("final_output")
def q_final_output(spark, sf):
    return doubles(P.final_output(_cleaned(spark, sf), PARAMS))


@query("final_unclean")
def q_final_unclean(spark, sf):
    """The same pipeline without the cleaning stage."""
    p = replace(PARAMS, clean=False)
    return doubles(P.final_output(P.clean_stage(P.Inputs.from_fixtures(spark, sf), p), p))


def _exported(spark, sf, *names: str) -> str:
    """Derived tables as raw CSV (S3), NULL as ``(null)`` in the sentinel columns,
    written twice into one scratch folder (S5: the second run replaces the first)."""
    t = fixtures.Tables(spark, sf, bucketed=False)
    base = f"{store.scratch(spark)}/csv-{uuid.uuid4().hex}"
    for _ in range(2):
        for name in names:
            raw = fixtures.as_raw_strings(t.table(name), SENTINEL_COLUMNS.get(name, []))
            csv_io.write_csv(raw, f"{base}/{name}.csv", EXPORT_CODEC)
    return base


@query("csv_load")
def q_csv_load(spark, sf):
    """S1 + C1 + C4: the exported items, read back raw and cleaned."""
    return doubles(P.Inputs.from_csv(spark, _exported(spark, sf, "receipt_items")).items)


@query("csv_customers")
def q_csv_customers(spark, sf):
    """S1 + S3 + C2 + C8: customers through CSV; blanks, quotes and paddings survive."""
    return clean.clean_customers(P.Inputs.from_csv(spark, _exported(spark, sf, "customers")).customers)


@query("csv_round_trip")
def q_csv_round_trip(spark, sf):
    """Export the derived tables, load them and run the pipeline."""
    base = _exported(spark, sf, "receipts", "customers", "retailers", "brands", "receipt_item_details",
                     "receipt_items")
    return doubles(P.final_output(P.clean_stage(P.Inputs.from_csv(spark, base), PARAMS), PARAMS))


@query("csv_typed")
def q_csv_typed(spark, sf):
    """S3 + S7: the final table exported as CSV and read again with inferred types."""
    path = f"{store.scratch(spark)}/csv-{uuid.uuid4().hex}/final_output.csv"
    csv_io.write_csv(_final_once(spark, sf), path, EXPORT_CODEC)
    return doubles(infer.read_typed_csv(spark, path))


@query("customer_age")
def q_customer_age(spark, sf):
    c = _tables(spark, sf).customers()
    return c.select("id", "birth_date", completed_years("birth_date", PARAMS.as_of).alias("age"))


@query("created_at_mst")
def q_created_at_mst(spark, sf):
    r = _tables(spark, sf).receipts()
    return r.select("id", wallclock_at_offset("created_at", PARAMS.zone).alias("created_at_mst"))


# -- O: profiling ------------------------------------------------------------

@query("avg_age")
def q_avg_age(spark, sf):
    return profile.mean_by(_final(spark, sf), "age", None, ["customer_id", "age"],
                           where=F.col("age") <= 90, alias="avg_age")


@query("age_by_gender")
def q_age_by_gender(spark, sf):
    return profile.mean_by(_final(spark, sf), "age", ["gender"], ["customer_id", "gender", "age"],
                           where=F.col("age") <= 90, alias="average_age")


@query("share_gender")
def q_share_gender(spark, sf):
    return profile.share(_final(spark, sf), "gender", ["customer_id"])


@query("share_state")
def q_share_state(spark, sf):
    return profile.ordered_share(profile.share(_final(spark, sf), "state", ["customer_id"]), "state")


@query("spend_by_state_receipts")
def q_spend_by_state_receipts(spark, sf):
    """O5 over receipts: equal totals of one customer count each."""
    m = profile.mean_by(_final(spark, sf), "total_price", ["state"],
                        ["receipt_id", "customer_id", "state", "total_price"], scale=2, alias="average_spend")
    return doubles(m)


@query("spend_by_state")
def q_spend_by_state(spark, sf):
    m = profile.mean_by(_final(spark, sf), "total_price", ["state"],
                        ["customer_id", "state", "total_price"], scale=2, alias="average_spend")
    return doubles(m.orderBy(F.col("average_spend").desc_nulls_first(), "state"))


@query("share_brand")
def q_share_brand(spark, sf):
    s = profile.share(_final(spark, sf), "brand_name", None, "brand_count", "brand_percent")
    return profile.ordered_share(s, "brand_name", "brand_percent")


@query("share_education")
def q_share_education(spark, sf):
    return profile.ordered_share(
        profile.share(_final(spark, sf), "education", ["customer_id"]), "education")


def _retailer_share(spark, sf, entity):
    s = profile.share(_final(spark, sf), "retailer_type", entity,
                      count_alias="retailer_count", pct_alias="retailer_percent")
    return profile.ordered_share(s, "retailer_type", "retailer_percent")


@query("share_retailer_items")
def q_share_retailer_items(spark, sf):
    return _retailer_share(spark, sf, None)


@query("share_retailer_receipts")
def q_share_retailer_receipts(spark, sf):
    return _retailer_share(spark, sf, ["receipt_id"])


@query("ranked_states")
def q_ranked_states(spark, sf):
    """L1: the ordered report with each row's place in it."""
    return profile.numbered(profile.ordered_share(
        profile.share(_final(spark, sf), "state", ["customer_id"]), "state"))


@query("ranked_brands")
def q_ranked_brands(spark, sf):
    s = profile.share(_final(spark, sf), "brand_name", None, "brand_count", "brand_percent")
    return profile.numbered(profile.ordered_share(s, "brand_name", "brand_percent"))


@query("top_states")
def q_top_states(spark, sf):
    return profile.top_share(profile.share(_final(spark, sf), "state", ["customer_id"]),
                             "state", TOP_STATES)


@query("top_brands")
def q_top_brands(spark, sf):
    s = profile.share(_final(spark, sf), "brand_name", None, "brand_count", "brand_percent")
    return profile.top_share(s, "brand_name", TOP_BRANDS, "brand_percent")


# Every report of observations, by the names of its own query.
def _reports() -> list[profile.Report]:
    return [
        profile.Report("avg_age", None, "customer_id", "age", F.col("age") <= 90),
        profile.Report("age_by_gender", "gender", "customer_id", "age", F.col("age") <= 90),
        profile.Report("share_gender", "gender", "customer_id"),
        profile.Report("share_state", "state", "customer_id"),
        profile.Report("spend_by_state", "state", "customer_id", "total_price", scale=2),
        profile.Report("share_brand", "brand_name"),
        profile.Report("share_education", "education", "customer_id"),
        profile.Report("share_retailer_items", "retailer_type"),
        profile.Report("share_retailer_receipts", "retailer_type", "receipt_id"),
    ]


@query("all_reports")
def q_all_reports(spark, sf):
    """O1-O9 from one scan of the final table."""
    return profile.reports(_final(spark, sf), _reports())


# -- E: temporal / distribution ----------------------------------------------

def _prepped(spark, sf) -> DataFrame:
    return temporal.prep(_final(spark, sf))


def _cube(spark, sf) -> DataFrame:
    """The stored count cube of the final table, with date parts: all that E3-E9 read."""
    key = f"cube-{fixtures.fingerprint(spark, sf, fixtures.RECEIPT_SOURCES)}"
    return temporal.cube_rows(fixtures.loaded(spark, "cube", key, lambda: temporal.count_cube(_prepped(spark, sf))))


@query("eda_prep")
def q_eda_prep(spark, sf):
    return doubles(_prepped(spark, sf))


@query("daily_counts")
def q_daily_counts(spark, sf):
    return temporal.daily_counts(_cube(spark, sf), count="n")


@query("daily_counts_filtered")
def q_daily_counts_filtered(spark, sf):
    return temporal.daily_counts(_filtered(spark, sf), count="n")


def _rounded(df: DataFrame, cols: list[str], digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("daily_band")
def q_daily_band(spark, sf):
    band = temporal.daily_band(temporal.daily_counts(_cube(spark, sf), count="n"))
    return _rounded(band, ["mean", "sd", "lower", "upper"], FLOAT_DIGITS)


def _filtered(spark, sf) -> DataFrame:
    return temporal.filter_optional(_cube(spark, sf), FILTER_STATE, FILTER_RETAILER_TYPE)


def _hist(daily: DataFrame) -> DataFrame:
    return _rounded(temporal.weekpart_hist(daily), ["bin_lo", "bin_hi", "density"], DENSITY_DIGITS)


def _kde(daily: DataFrame) -> DataFrame:
    k = temporal.weekpart_kde(daily)
    return _rounded(k, ["x"], FLOAT_DIGITS).withColumn("density", F.round("density", DENSITY_DIGITS))


# The final table's days come from order dates; its purchase times are all the
# same hour, so the queries by hour read the events table besides.

@query("weekpart_daily")
def q_weekpart_daily(spark, sf):
    return temporal.weekpart_daily(_cube(spark, sf), count="n_known")


@query("weekpart_daily_filtered")
def q_weekpart_daily_filtered(spark, sf):
    return temporal.weekpart_daily(_filtered(spark, sf), count="n_known")


@query("weekpart_hist")
def q_weekpart_hist(spark, sf):
    return _hist(temporal.weekpart_daily(_cube(spark, sf), count="n_known"))


@query("weekpart_kde")
def q_weekpart_kde(spark, sf):
    return _kde(temporal.weekpart_daily(_cube(spark, sf), count="n_known"))


@query("weekpart_daily_events")
def q_weekpart_daily_events(spark, sf):
    return temporal.weekpart_daily(_events(spark, sf))


@query("weekpart_hist_events")
def q_weekpart_hist_events(spark, sf):
    return _hist(temporal.weekpart_daily(_events(spark, sf)))


@query("weekpart_kde_events")
def q_weekpart_kde_events(spark, sf):
    return _kde(temporal.weekpart_daily(_events(spark, sf)))


@query("hour_counts")
def q_hour_counts(spark, sf):
    return temporal.hour_counts(_events(spark, sf))


@query("hour_counts_filtered")
def q_hour_counts_filtered(spark, sf):
    return temporal.hour_counts(_filtered(spark, sf), count="n")


@query("hour_pivot")
def q_hour_pivot(spark, sf):
    return temporal.hour_pivot(temporal.hour_counts(_events(spark, sf)))


@query("hour_box")
def q_hour_box(spark, sf):
    b = temporal.hour_box(temporal.hour_counts(_events(spark, sf)))
    return _rounded(b, ["mean", "q1", "med", "q3"], FLOAT_DIGITS)


@query("hour_box_final")
def q_hour_box_final(spark, sf):
    b = temporal.hour_box(temporal.hour_counts(_cube(spark, sf), count="n"))
    return _rounded(b, ["mean", "q1", "med", "q3"], FLOAT_DIGITS)


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
