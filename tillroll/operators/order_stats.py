"""Order statistics (M1-M6) and top-k.

The reference's "median" is a lower-half median::

    avg of (top 2 of (first n div 2 ascending values))

i.e. the mean of the 1-based ranks ``m-1`` and ``m`` with ``m = n div 2``
(NULL for n <= 1, the single value ``x[1]`` for n = 2, 3). Its SQL needs an
unfoldable ``LIMIT (subquery)``, which Spark rejects, and a global sort.

Spark form, without any single-task sort of the rows:

1. ``percentile_approx`` finds, combined on the map side, two values that
   enclose the wanted ranks: its rank error is at most n / accuracy, so the
   quantiles ``MARGIN / accuracy`` to either side of the ranks hold them for
   certain, however the values are spread (one huge value among many small
   ones moves nothing).
2. That leaves a fixed share of the values, about 1 in 2,500. While this may be
   more than ``MOST_RANKED``, the rows strictly between the two values are counted
   and enclosed again: every round divides them by 2,500, so 10^12 rows take two.
   Values that many rows share become an end of the interval and count as one.
3. Values below the interval are only counted; the ``MOST_RANKED`` distinct values
   in it at most are ranked exactly.

Several series (price, quantity, receipt total) run in the same jobs; one row per
series and round reaches the driver. The values at the two ranks are combined
with integer weights and rounded once (half away from zero).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numeric import DEC, exact_mean

ACCURACY = 20_000
MARGIN = 3
MOST_RANKED = 100_000


def _quantiles(v: Column, fractions: tuple[float, float], accuracy: int) -> Column:
    low, high = (min(1.0, max(0.0, f)) for f in fractions)
    return F.percentile_approx(v, [low, high], accuracy)


def enclosing(values: DataFrame, ranks: Callable[[int], tuple[int, int]], accuracy: int = ACCURACY,
              most: int | None = None) -> dict:
    """Per series ``g`` of ``values`` (``g, v``): ``(n, lo, hi)``, so that the
    ranks ``ranks(n)`` lie in [lo, hi] and ``most`` distinct values at most do.

    Below ``4 * accuracy`` rows the margin would be under two ranks; then the
    interval holds all values.
    """
    most = max(MOST_RANKED if most is None else most, 4 * accuracy)
    v, margin = F.col("v"), MARGIN / accuracy
    first = values.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
        _quantiles(v, (0.5 - margin, 0.5 + margin), accuracy).alias("q")).collect()
    out, left = {}, {}
    for r in first:
        wide = r["n"] < 4 * accuracy or margin >= 0.5
        out[r["g"]] = (r["n"], r["least"], r["most"]) if wide else (r["n"], *r["q"])
        left[r["g"]] = r["n"] if wide else _inside(r["n"], accuracy)
    while wide := [g for g, n in left.items() if n > most and out[g][1] != out[g][2]]:
        # Where the ranks lie relative to the values at both ends.
        counts = values.where(F.col("g").isin(wide)).agg(*[
            F.count(F.when((F.col("g") == g) & c, 1)).alias(f"{k}{i}") for i, g in enumerate(wide)
            for k, c in (("low", v <= out[g][1]), ("high", v < out[g][2]))]).first()
        strictly = {}
        for i, g in enumerate(wide):
            n, lo, hi = out[g]
            a, b = ranks(n)
            if b <= counts[f"low{i}"]:
                out[g] = (n, lo, lo)
            elif a > counts[f"high{i}"]:
                out[g] = (n, hi, hi)
            else:
                strictly[g] = (counts[f"low{i}"], counts[f"high{i}"] - counts[f"low{i}"], a, b)
        if not strictly:
            break
        open_ = {g: (F.col("g") == g) & (v > out[g][1]) & (v < out[g][2]) for g in strictly}
        fractions = {g: ((a - below) / n - margin, (b - below) / n + margin)
                     for g, (below, n, a, b) in strictly.items()}
        got = values.where(F.col("g").isin(list(strictly))).agg(*[
            _quantiles(F.when(open_[g], v), fractions[g], accuracy).alias(f"q{i}")
            for i, g in enumerate(strictly)]).first()
        for i, g in enumerate(strictly):
            n, lo, hi = out[g]
            low, high = fractions[g]
            q = got[f"q{i}"] or [lo, hi]
            out[g] = (n, lo if low <= 0 else q[0], hi if high >= 1 else q[1])
            # An accuracy too small to halve the rows ends here, with all of them.
            left[g] = min(_inside(strictly[g][1], accuracy), left[g] - 1) if accuracy > 10 * MARGIN else 0
    return out


def _inside(n: int, accuracy: int) -> int:
    """Rows that enclosing quantiles of ``n`` rows leave strictly between them, at most."""
    return n * 2 * (MARGIN + 2) // accuracy + 2


def _by_series(spots: dict, at: int) -> Column:
    out = F.lit(None).cast(DEC)
    for g, spot in spots.items():
        out = F.when(F.col("g") == g, F.lit(spot[at])).otherwise(out)
    return out


def _counted(values: DataFrame, spots: dict) -> DataFrame:
    """``g, v, c, cum`` of the distinct values inside the intervals of ``spots``;
    all values below an interval count as one row at its front."""
    v = F.col("v")
    inside = values.withColumns({"lo": _by_series(spots, 1), "hi": _by_series(spots, 2)}).where(v <= F.col("hi"))
    hist = inside.groupBy("g", F.when(v >= F.col("lo"), v).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("cum", F.sum("c").over(upto)).where(F.col("v").isNotNull())


def _lower_half(n: int) -> tuple[int, int]:
    return max(1, n // 2 - 1), max(1, n // 2)


def lower_half_medians(values: DataFrame, scales: dict[str, int] | None = None,
                       buckets: int = ACCURACY, most: int | None = None) -> DataFrame:
    """Lower-half medians of several series in the same jobs.

    ``values`` has columns ``g`` (series name) and ``v`` (decimal, already
    filtered to the qualifying rows). Returns ``g, median`` with one row per
    series of at least two rows, rounded to ``scales[g]`` places (default 2).
    ``buckets`` is the accuracy of the enclosing quantiles and ``most`` the number
    of distinct values one task may rank; the result does not depend on them.
    """
    vals = values.where(F.col("v").isNotNull())
    spots = enclosing(vals, _lower_half, buckets, most)
    m = F.lit(None).cast("long")
    for g, (n, _, _) in spots.items():
        m = F.when(F.col("g") == g, F.lit(n // 2)).otherwise(m)
    counted = _counted(vals, spots).withColumn("m", m)
    w = F.greatest(F.lit(0), F.least(F.col("cum"), F.col("m"))
                   - F.greatest(F.col("cum") - F.col("c"), F.col("m") - 2))
    ranked = counted.groupBy("g").agg(F.sum(F.col("v") * w).alias("sv"), F.sum(w).alias("sw"))
    med = exact_mean("sv", "sw", 2)
    for name, k in (scales or {}).items():
        med = F.when(F.col("g") == name, exact_mean("sv", "sw", k)).otherwise(med)
    return ranked.select("g", med.cast(DEC).alias("median"))


def _series(df: DataFrame, col: str, where: Column | None) -> DataFrame:
    src = df.where(where) if where is not None else df
    return src.select(F.lit(col).alias("g"), F.col(col).alias("v")).where(F.col("v").isNotNull())


def lower_half_median(df: DataFrame, col: str, where: Column | None = None,
                      scale: int = 2, buckets: int = ACCURACY,
                      alias: str = "median", most: int | None = None) -> DataFrame:
    """M1-M3: one row, ``alias`` = lower-half median of ``col`` over ``where``
    (NULL when fewer than two values qualify)."""
    found = lower_half_medians(_series(df, col, where), {col: scale}, buckets, most)
    return found.agg(F.max("median").alias(alias))


def exact_median(df: DataFrame, col: str, where: Column | None = None,
                 alias: str = "median", buckets: int = ACCURACY, most: int | None = None) -> DataFrame:
    """M6: the true median (mean of the two middle values for even n), as a double."""
    vals = _series(df, col, where)
    spots = enclosing(vals, lambda n: ((n + 1) // 2, n // 2 + 1), buckets, most)
    n = spots[col][0] if spots else 0
    counted, v = _counted(vals, spots), F.col("v")
    lower = F.min(F.when(F.col("cum") >= (n + 1) // 2, v))
    upper = F.min(F.when(F.col("cum") >= n // 2 + 1, v))
    return counted.agg((lower.cast("double") * 0.5 + upper.cast("double") * 0.5).alias(alias))


def top_k(df: DataFrame, col: str, k: int, tiebreak: list[str] | None = None,
          ascending: bool = False) -> DataFrame:
    """The ``k`` rows with the largest (or smallest) ``col``.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: every partition
    keeps its own top k, only those reach the final merge. NULLs sort first
    when descending, as PostgreSQL's ``DESC``; ties are broken by ``tiebreak``.
    """
    c = F.col(col)
    first = c.asc_nulls_last() if ascending else c.desc_nulls_first()
    rest = [F.col(t).asc_nulls_first() for t in (tiebreak or [])]
    return df.orderBy(first, *rest).limit(k)
