"""Receipt-model tables derived from the driver's TPC-H-like parquet tables.

The reference ships no data; ``FIXTURES.md`` fixes deterministic rules that
turn ``orders``, ``lineitem``, ``part``, ``customer``, ``supplier``,
``nation`` and ``region`` into the seven receipt tables with the same dirt
the reference cleans (sentinels, zeros, negatives, extreme values, blank
genders, orphans). Every rule is a column expression, so the derivation is a
scan + projection (+ one join to a dimension) that grows with the input.
"""

from __future__ import annotations

import datetime as _dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tillroll.functions.numeric import DEC
from tillroll.functions.timecols import instant_from_utc_wallclock
from tillroll.sources import store

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")

RECEIPT_SOURCES = DRIVER_TABLES[:-1]

# Fixed values of the fixture (FIXTURES.md): reference as-of date for ages,
# the raised caps for this data, and the missing-value token.
AS_OF = "2017-09-01"
PRICE_CAP = 200000
TOTAL_CAP = 1000000
NULL_TOKEN = "(null)"
BIRTH_EPOCH = _dt.date(1920, 1, 1)
ORDERS_PER_RETAILER = 150       # orders and suppliers grow by the same factor


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _dealt(source: DataFrame, by: Column, buckets: int | None) -> DataFrame:
    """``source`` dealt as its derived rows are to lie: it is narrower than these."""
    return source.repartition(buckets, by) if buckets else source


def receipts(orders: DataFrame, buckets: int | None = None) -> DataFrame:
    """receipts <- orders: id, customer_id, retailer_id, created_at, total_price.

    The retailer key grows with the orders, as the suppliers do; every 41st
    customer and every tenth retailer is referred to by a key no table has.
    ``buckets`` deals the rows by ``id``.
    """
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    shop = F.floor(k / ORDERS_PER_RETAILER)
    tp = F.col("o_totalprice").cast("decimal(18,2)")
    total = (F.when(k % 7 == 0, None)
             .when(k % 11 == 0, 0)
             .when(shop % 10 == 3, None)
             .when((shop % 10 == 4) & (cust % 2 == 0), 0)
             .when(k % 997 == 0, tp * 1000)
             .when(k % 97 == 0, tp * 2)
             .when(k % 509 == 0, -tp)
             .otherwise(tp)).cast(DEC)
    return _dealt(orders, _s(k), buckets).select(
        _s(k).alias("id"),
        F.when(cust % 41 == 0, F.concat(F.lit("gone-"), _s(cust))).otherwise(_s(cust)).alias("customer_id"),
        F.when(shop % 10 == 9, F.concat(F.lit("gone-"), _s(shop))).otherwise(_s(shop)).alias("retailer_id"),
        instant_from_utc_wallclock("o_orderdate").alias("created_at"),
        total.alias("total_price"))


def _lineitem_part(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    # part is a dimension of lineitem (FK join); AQE broadcasts it when small
    # and keeps a sort-merge join otherwise.
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                         "l_quantity", "l_extendedprice")
    p = part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return li.join(p, li.l_partkey == p.p_partkey, "inner")


def _item_id() -> Column:
    return F.concat_ws("-", *[_s(F.col(c)) for c in
                              ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                       _s(F.col("l_quantity").cast("int")))


def receipt_lines(lineitem: DataFrame, part: DataFrame, buckets: int | None = None) -> DataFrame:
    """The columns of receipt_items and receipt_item_details, a row per lineitem.

    Both tables are columns of the same rows, so the load stage derives and
    moves each row once and a reader takes the columns of its table. ``buckets``
    deals the rows by ``receipt_item_id``.
    """
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    gone = (F.col("p_size") % 10 == 0) | (F.col("p_brand") == "Brand#7")
    ep = F.col("l_extendedprice").cast("decimal(18,2)")
    price = (F.when(gone, None)
             .when(pk % 13 == 0, 0)
             .when(pk % 19 == 0, None)
             .when(ok % 5 == 0, None)
             .when(ok % 23 == 0, 0)
             .when(ok % 29 == 0, F.lit(-1.25).cast(DEC))
             .when(ok % 499 == 0, ep * 1000)
             .when(ok % 211 == 0, ep * 2)
             .when(ok % 503 == 0, -ep)
             .otherwise(ep)).cast(DEC)
    qty = (F.when(gone, None)
           .when(pk % 13 == 0, 0)
           .when(ok % 6 == 0, None)
           .when(ok % 31 == 0, 0)
           .when(ok % 37 == 0, -1)
           .otherwise(F.col("l_quantity").cast("decimal(18,2)"))).cast(DEC)
    return _dealt(_lineitem_part(lineitem, part), _item_id(), buckets).select(
        _item_id().alias("receipt_item_id"), price.alias("price"), qty.alias("quantity"),
        _s(ok).alias("receipt_id"),
        F.col("p_type").alias("primary_category_id"),
        _s(F.col("p_size")).alias("secondary_category_id"),
        F.when(pk % 3 != 0, F.col("p_name")).alias("tertiary_category_id"),
        F.when(F.col("p_brand") == "Brand#5", "gone-Brand#5").when(
            pk % 17 != 0, F.col("p_brand")).alias("brand_id"),
        _s(pk).alias("global_product_id"))


#: Tables that are columns of ``receipt_lines``.
OF_LINES = {
    "receipt_items": ["receipt_item_id", "price", "quantity"],
    "receipt_item_details": ["receipt_item_id", "receipt_id", "primary_category_id", "secondary_category_id",
                             "tertiary_category_id", "brand_id", "global_product_id"],
}


def receipt_items(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """receipt_items <- lineitem x part: receipt_item_id, price, quantity."""
    return receipt_lines(lineitem, part).select(*OF_LINES["receipt_items"])


def receipt_item_details(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """receipt_item_details <- lineitem x part."""
    return receipt_lines(lineitem, part).select(*OF_LINES["receipt_item_details"])


def customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """customers <- customer x nation."""
    ck = F.col("c_custkey")
    gender = F.when(ck % 10 < 7, "F").when(ck % 10 < 9, "M").otherwise(" ")
    birth = F.when(ck % 29 != 0,
                   F.date_add(F.lit(BIRTH_EPOCH), ((ck * 7919) % 33000).cast("int")))
    edu = (F.when(F.col("c_mktsegment") == "BUILDING",
                  F.when(ck % 2 == 0, "none").otherwise(""))
           .otherwise(F.col("c_mktsegment")))
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = nation.select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "inner").select(
        _s(ck).alias("id"), gender.alias("gender"), birth.alias("birth_date"),
        edu.alias("education"), F.col("n_name").alias("state"))


def retailers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """retailers <- supplier x nation x region."""
    s = supplier.select("s_suppkey", "s_nationkey")
    n = nation.select("n_nationkey", "n_regionkey")
    r = region.select("r_regionkey", "r_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .select(_s(F.col("s_suppkey")).alias("id"), F.col("r_name").alias("retailer_type")))


def brands(part: DataFrame) -> DataFrame:
    """brands <- distinct p_brand; Brand#3 needs verification."""
    b = part.select("p_brand").distinct()
    name = F.when(F.col("p_brand") == "Brand#3", "Needs Verification") \
        .otherwise(F.concat(F.lit("Name "), F.col("p_brand")))
    return b.select(F.col("p_brand").alias("id"), name.alias("name"))


def product_categories(part: DataFrame) -> DataFrame:
    """product_categories <- distinct p_type (loaded by the reference, never read)."""
    return part.select(F.col("p_type").alias("id")).distinct() \
        .withColumn("name", F.lower(F.col("id")))


def as_raw_strings(df: DataFrame, sentinel_cols: list[str], token: str = NULL_TOKEN) -> DataFrame:
    """Render a typed table the way its CSV export looks: every column a string
    (numbers with their two decimals), NULL written as ``token`` in the
    sentinel-bearing columns (to exercise C1/C4)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        c = (c.cast("decimal(18,2)") if isinstance(f.dataType, DecimalType) else c).cast("string")
        if f.name in sentinel_cols:
            c = F.coalesce(c, F.lit(token))
        out.append(c.alias(f.name))
    return df.select(*out)


_SOURCES = {
    "receipts": (receipts, ("orders",)),
    "receipt_lines": (receipt_lines, ("lineitem", "part")),
    "receipt_items": (receipt_items, ("lineitem", "part")),
    "receipt_item_details": (receipt_item_details, ("lineitem", "part")),
    "customers": (customers, ("customer", "nation")),
    "retailers": (retailers, ("supplier", "nation", "region")),
    "brands": (brands, ("part",)),
    "product_categories": (product_categories, ("part",)),
}


def fingerprint(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> str:
    """Digest of the files (path, length, time of change) of the given tables,
    listed by Hadoop's file system, so any store and any path form works."""
    seen = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(path)
        for f in (fs.listStatus(path) if status.isDirectory() else [status]):
            seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:16]


#: Buckets of the loaded tables: the columns of J1 and J2.
BUCKETS = {"receipts": "id", "receipt_lines": "receipt_item_id"}


def loaded(spark: SparkSession, kind: str, key: str, make, bucket: str | None = None,
           tag: str | None = None, row: str | None = None) -> DataFrame:
    """The table stored under ``key``, written by ``make()`` if it is not there.

    The folder lies under the shared checkpoint folder and names the
    application and the input files' digest, so changed inputs never meet an
    older table; a table counts only once its writer has committed it.
    """
    path = f"{_loaded_folder(spark)}/{kind}/{key}"
    if not is_loaded(spark, kind, key):
        return store.write(make(), path, bucket, tag, row)
    return store.read(spark, path)


def is_loaded(spark: SparkSession, kind: str, key: str) -> bool:
    return store.exists(spark, f"{_loaded_folder(spark)}/{kind}/{key}/_SUCCESS")


def _loaded_folder(spark: SparkSession) -> str:
    return f"{store.scratch(spark)}/loaded"


def drop_loaded(spark: SparkSession) -> None:
    """Delete what ``loaded`` has stored for this application."""
    store.delete(spark, _loaded_folder(spark))


class Tables:
    """The receipt model over one driver directory.

    With ``materialize`` (the default) a table is derived on its first use and
    written as parquet under the shared checkpoint folder - the load stage the
    reference performs with ``\\copy`` - then read back. Later stages see
    plain typed columns (small expressions, parquet column pruning and
    statistics for adaptive join planning) instead of the derivation rules
    inlined into every filter, and the lineage of every query starts at the
    loaded tables. Tables that a query does not read are never derived.

    Without ``bucketed`` the rows are stored as they come, for readers that scan
    them and join nothing: they do not move. Tables that lie in buckets already
    are read from these.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True, bucketed: bool = True):
        self.spark, self.sf_dir, self.materialize, self.bucketed = spark, sf_dir, materialize, bucketed

    def driver(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def _derive(self, name: str, **dealt: int) -> DataFrame:
        rule, sources = _SOURCES[name]
        return rule(*[self.driver(x) for x in sources], **dealt)

    def table(self, name: str) -> DataFrame:
        if not self.materialize:
            return self._derive(name)
        if name in OF_LINES:
            return self.table("receipt_lines").select(*OF_LINES[name])
        key = f"{name}-{fingerprint(self.spark, self.sf_dir, _SOURCES[name][1])}"
        dealt = {"buckets": store.buckets(self.spark)} if name in BUCKETS else {}
        if dealt and not self.bucketed and not is_loaded(self.spark, "load", key):
            return loaded(self.spark, "plain", key, lambda: self._derive(name))
        return loaded(self.spark, "load", key, lambda: self._derive(name, **dealt), BUCKETS.get(name))

    def receipts(self) -> DataFrame:
        return self.table("receipts")

    def receipt_items(self) -> DataFrame:
        return self.table("receipt_items")

    def receipt_item_details(self) -> DataFrame:
        return self.table("receipt_item_details")

    def customers(self) -> DataFrame:
        return self.table("customers")

    def retailers(self) -> DataFrame:
        return self.table("retailers")

    def brands(self) -> DataFrame:
        return self.table("brands")

    def product_categories(self) -> DataFrame:
        return self.table("product_categories")
