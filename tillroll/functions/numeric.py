"""Exact rounding helpers.

A mean computed as ``round(avg(x), k)`` rounds twice in Spark (``avg`` of a
decimal keeps only 4 extra digits, a wide decimal quotient is cut to fit 38
digits), so a group whose true mean is 1.00499975 would come out as 1.01. The
helpers here round ``sum / n`` once, half away from zero, with the integral
``div`` operator, which is exact for any group size.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Storage type of money and quantities after the strict numeric cast: wide
# enough that no digit of a price or quantity is lost; values with more
# decimals than SCALE fail the cast instead of being cut.
PRECISION, SCALE = 24, 6
DEC = f"decimal({PRECISION},{SCALE})"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: Column, b: Column) -> Column:
    """Exact integral quotient ``a div b`` (truncates toward zero)."""
    return F.call_function("div", a, b)


def rounded_units(total: Column | str, n: Column | str, scale: int) -> Column:
    """round(total / n, scale), half away from zero, in units of 10^-scale (bigint).

    ``total`` is a decimal or integral sum and ``n`` a count. NULL when ``n``
    is 0 / NULL or ``total`` is NULL, as ``ROUND(AVG(x))`` over no values.
    """
    t, k = _c(total), _c(n)
    q = idiv(F.abs(t) * (2 * 10 ** scale) + k, k * 2)
    return F.when((k > 0) & t.isNotNull(), F.when(t < 0, -q).otherwise(q))


def units_to_decimal(units: Column, scale: int, precision: int = 18) -> Column:
    """A count of 10^-scale units as ``decimal(precision, scale)``, exactly."""
    step = F.lit(Decimal(1).scaleb(-scale))
    return (units.cast(f"decimal({precision},0)") * step).cast(f"decimal({precision},{scale})")


def exact_mean(total: Column | str, n: Column | str, scale: int) -> Column:
    """round(total / n, scale) as a decimal, rounded once (see module doc)."""
    return units_to_decimal(rounded_units(total, n, scale), scale)


def rounded_ratio_pct(part: Column | str, whole: Column | str, scale: int = 2) -> Column:
    """round(part * 100 / whole, scale) half away from zero, as a double.

    Matches ``ROUND(COUNT(c) * 100.0 / total, 2)`` on exact numerics; the
    integral form stays exact however large the counts grow.
    """
    p, w = _c(part), _c(whole)
    units = rounded_units(p.cast("decimal(38,0)") * 100, w, scale)
    return units.cast("double") / float(10 ** scale)
