"""Outlier removal (C5, C6): fixed caps, then k-sigma bounds.

Both set values to NULL (the reference's comments say "zero", its code writes
NULL, and the difference matters because zeros would enter the means).

Bounds of decimal and integral columns are exact. A value is a whole number of
units of its last digit, cut into two limbs of ``LIMB_DIGITS``; count, sum and the
three limb products are decimal sums, which combine in any order to the same
digits. The one row of sums gives the bounds in integers, so they do not depend
on the partitioning and a value that equals a bound stays. Doubles use Spark's
``avg`` and ``stddev_samp``.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from tillroll.functions.numeric import idiv
from tillroll.functions.scalars import one_row

# Values of up to 26 digits: limb products have 26 digits at most, so sums of
# 10^12 rows fit the 38 digits of a decimal (a wider sum fails, it never wraps).
LIMB_DIGITS = 13
WIDEST = 2 * LIMB_DIGITS
REPORT_DIGITS = 60          # digits the reported bounds are computed with


def null_above(df: DataFrame, col: str, cap: float) -> DataFrame:
    """Values strictly greater than ``cap`` become NULL (upper side only)."""
    c = F.col(col)
    return df.withColumn(col, F.when(c > F.lit(cap), F.lit(None)).otherwise(c))


@dataclass(frozen=True)
class Moments:
    """Count, sum and sum of squares of a column, in units of 10^-scale."""

    n: int
    total: int
    squares: int
    scale: int

    def _radicand(self, k: Fraction) -> Fraction:
        """(n * k * stddev_samp)^2."""
        return k * k * self.n * (self.n * self.squares - self.total ** 2) / (self.n - 1)

    def limits(self, k: float) -> tuple[Decimal, Decimal] | None:
        """The least and the greatest number of the column's scale that is not
        outside mean -/+ k * stddev_samp; None under two values."""
        if self.n < 2:
            return None
        r = self._radicand(Fraction(k))
        root = isqrt(r.numerator // r.denominator)
        low, high = -((root - self.total) // self.n), (self.total + root) // self.n
        return Decimal(low).scaleb(-self.scale), Decimal(high).scaleb(-self.scale)

    def bounds(self, k: float) -> tuple[float, float] | None:
        """mean -/+ k * stddev_samp as the nearest doubles."""
        if self.n < 2:
            return None
        r = self._radicand(Fraction(k))
        with localcontext(prec=REPORT_DIGITS):
            root = (Decimal(r.numerator) / r.denominator).sqrt()
            unit = Decimal(self.n).scaleb(self.scale)
            return float((self.total - root) / unit), float((self.total + root) / unit)


def is_exact(df: DataFrame, col: str) -> bool:
    kind = df.schema[col].dataType
    return isinstance(kind, IntegralType) or isinstance(kind, DecimalType) and kind.precision <= WIDEST


def moment_sums(df: DataFrame, col: str) -> DataFrame:
    """One row ``n, high, low, high_high, high_low, low_low``: sums over the limbs."""
    kind = df.schema[col].dataType
    scale = kind.scale if isinstance(kind, DecimalType) else 0
    limb, wide = F.lit(Decimal(10 ** LIMB_DIGITS)), f"decimal({WIDEST},0)"
    units = (F.col(col).cast(f"decimal({WIDEST},{scale})") * F.lit(Decimal(10 ** scale))).cast(wide)
    cut = df.select(units.alias("u")).select(
        idiv(F.col("u"), limb).alias("h"), (F.col("u") % limb).cast(wide).alias("l"))

    def total(x: Column, alias: str) -> Column:
        return F.sum(x.cast("decimal(28,0)")).alias(alias)

    h, l_ = F.col("h").cast("decimal(14,0)"), F.col("l").cast("decimal(14,0)")
    return cut.agg(F.count("l").alias("n"), total(h, "high"), total(l_, "low"), total(h * h, "high_high"),
                   total(h * l_, "high_low"), total(l_ * l_, "low_low"))


def moments(df: DataFrame, col: str) -> Moments:
    """Exact moments of a decimal or integral column (one distributed job)."""
    kind = df.schema[col].dataType
    row = one_row(moment_sums(df, col))
    base = 10 ** LIMB_DIGITS
    high, low, hh, hl, ll = (int(row[c] or 0) for c in ("high", "low", "high_high", "high_low", "low_low"))
    return Moments(row["n"], high * base + low, hh * base ** 2 + 2 * hl * base + ll,
                   kind.scale if isinstance(kind, DecimalType) else 0)


def sigma_bounds(df: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """One row ``(lower_bound, upper_bound) = mean -/+ k * stddev_samp``, as
    doubles (NULL under two values). Zeros and negatives count; NULLs do not."""
    if is_exact(df, col):
        found = moments(df, col).bounds(k) or (None, None)
        return df.sparkSession.createDataFrame([found], "lower_bound double, upper_bound double")
    mean, sd = F.avg(col), F.stddev_samp(col)
    return df.agg((mean - sd * k).alias("lower_bound"), (mean + sd * k).alias("upper_bound"))


def sigma_limits(df: DataFrame, col: str, k: float = 3.0) -> tuple | None:
    """The least and the greatest value that C6b keeps (None under two values)."""
    if is_exact(df, col):
        return moments(df, col).limits(k)
    lower, upper = one_row(sigma_bounds(df, col, k))
    return None if lower is None or upper is None else (lower, upper)


def null_outside(df: DataFrame, col: str, limits: tuple | None) -> DataFrame:
    """Values strictly outside ``limits`` (of ``sigma_limits``) become NULL."""
    if limits is None:                    # fewer than two values: nothing is outside
        return df
    c = F.col(col)
    outside = (c < F.lit(limits[0])) | (c > F.lit(limits[1]))
    return df.withColumn(col, F.when(outside, F.lit(None)).otherwise(c))


def remove_outliers(df: DataFrame, col: str, cap: float, k: float = 3.0) -> DataFrame:
    """C5 then C6, in the reference's order: the bounds come from the capped
    column, computed exactly once."""
    capped = null_above(df, col, cap)
    return null_outside(capped, col, sigma_limits(capped, col, k))
