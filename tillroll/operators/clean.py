"""Cleaning (C1-C4, C8-C11): each reference UPDATE becomes one projection.

``UPDATE t SET c = v WHERE p`` is ``c := CASE WHEN p THEN v ELSE c END``;
chained updates collapse into a single whole-stage-codegen projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import PRECISION, SCALE
from tillroll.sources.fixtures import NULL_TOKEN
from tillroll.sources.schemas import CHAR_WIDTHS, SENTINEL_COLUMNS

# Fixed values of the reference's cleaning rules.
EDUCATION_NONE = "none"
BRAND_UNVERIFIED = "Needs Verification"
BRAND_NO_INFO = "No Info"


def null_if_token(df: DataFrame, cols: Iterable[str], token: str = NULL_TOKEN) -> DataFrame:
    """The literal ``token`` becomes NULL in ``cols`` (other values untouched)."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(token)) for c in cols})


def recode(df: DataFrame, col: str, mapping: Mapping[str, str | None]) -> DataFrame:
    """Replace exact values of ``col`` (a value mapped to None becomes NULL)."""
    expr: Column | None = None
    c = F.col(col)
    for old, new in mapping.items():
        v = F.lit(new).cast("string")
        expr = F.when(c == old, v) if expr is None else expr.when(c == old, v)
    return df if expr is None else df.withColumn(col, expr.otherwise(c))


def to_decimal(df: DataFrame, cols: Iterable[str], precision: int = PRECISION,
               scale: int = SCALE, lenient: bool = False) -> DataFrame:
    """C4: string -> decimal. Strict by default: malformed text fails the job
    (ANSI cast), as the reference's ``::numeric``, and so does a value with
    more decimals than the storage keeps; ``lenient`` yields NULL for both."""
    t, wide = f"decimal({precision},{scale})", f"decimal(38,{min(2 * scale + 6, 38 - precision + scale)})"

    def strict(c: str) -> Column:
        kept = F.col(c).cast(t)
        return F.when(F.col(c).cast(wide) == kept, kept).when(F.col(c).isNull(), F.lit(None)).otherwise(
            F.raise_error(F.concat(F.lit(f"{c}: more than {scale} decimals in "), F.col(c))).cast(t))

    def tolerant(c: str) -> Column:
        kept, full = F.expr(f"try_cast(`{c}` as {t})"), F.expr(f"try_cast(`{c}` as {wide})")
        return F.when(full == kept, kept)

    return df.withColumns({c: tolerant(c) if lenient else strict(c) for c in cols})


def pad_char(df: DataFrame, col: str, n: int) -> DataFrame:
    """``char(n)`` storage pads shorter values with blanks ('' -> ' ').

    Longer values are left as they are (PostgreSQL would reject them)."""
    c = F.col(col)
    return df.withColumn(col, F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c))


def blank_to_null(df: DataFrame, col: str, blank: str = " ") -> DataFrame:
    """A blank placeholder becomes missing."""
    return df.withColumn(col, F.nullif(F.col(col), F.lit(blank)))


def flags_to_bool(df: DataFrame, cols: Iterable[str], yes: str = "yes") -> DataFrame:
    """C10: 'yes'/'no' text flags -> boolean (anything but ``yes`` is False)."""
    return df.withColumns({c: F.coalesce(F.col(c) == yes, F.lit(False)) for c in cols})


# -- per-table cleaning of the raw string tables -----------------------------

def clean_receipts(raw: DataFrame, lenient: bool = False) -> DataFrame:
    df = null_if_token(raw, SENTINEL_COLUMNS["receipts"])
    df = to_decimal(df, ["total_price"], lenient=lenient)
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


def clean_items(raw: DataFrame, lenient: bool = False) -> DataFrame:
    df = null_if_token(raw, SENTINEL_COLUMNS["receipt_items"])
    return to_decimal(df, ["price", "quantity"], lenient=lenient)


def clean_details(raw: DataFrame) -> DataFrame:
    return null_if_token(raw, SENTINEL_COLUMNS["receipt_item_details"])


def pad_declared(df: DataFrame, table: str) -> DataFrame:
    """C8 for every ``char(n)`` column that the table declares."""
    for col, width in CHAR_WIDTHS.get(table, {}).items():
        df = pad_char(df, col, width)
    return df


def clean_customers(df: DataFrame) -> DataFrame:
    """C2 + C8: education 'none' -> NULL; gender char(1), state char(2)."""
    df = recode(df, "education", {EDUCATION_NONE: None})
    return pad_declared(df, "customers")


def clean_brands(df: DataFrame) -> DataFrame:
    """An unverified brand name is recoded to 'No Info' (not NULL)."""
    return recode(df, "name", {BRAND_UNVERIFIED: BRAND_NO_INFO})
