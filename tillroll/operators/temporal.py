"""Temporal and distribution analysis (E1-E9): the data behind each plot.

Row work (filters, date parts, per-day and per-hour counts) runs on the full
table; everything after that works on per-day or per-(day, hour) counts,
whose size is bounded by the calendar, not by the data. Per-part statistics
(two parts: weekday, weekend) are small by construction and broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.clean import blank_to_null, flags_to_bool

# Fixed values of the reference's plots: months shown, band width, histogram
# bins, KDE grid size, box-plot whisker reach, age limit, weekday cut.
MONTHS = (9, 10, 11, 12)
BAND_K = 1.5
HIST_BINS = 20
KDE_POINTS = 100
WHISKER = 1.5
MAX_AGE = 90
LAST_WEEKDAY = 4          # Monday=0 ... Friday=4
WEEKDAY, WEEKEND = "weekday", "weekend"

TS = "created_at_mst"
CUBE_KEYS = ["date", "hour", "state", "retailer_type"]


def with_time_parts(df: DataFrame, ts: str = TS) -> DataFrame:
    """month, dayofweek (Monday=0), date and hour of ``ts``."""
    t = F.col(ts)
    return df.withColumns({
        "month": F.month(t).cast("long"),
        "dayofweek": F.weekday(t).cast("long"),
        "date": F.to_date(t),
        "hour": F.hour(t).cast("long"),
    })


def prep(df: DataFrame, max_age: int = MAX_AGE) -> DataFrame:
    """Blank gender -> NULL, ``age < max_age`` (rows without age drop out),
    yes/no flags -> boolean, time parts."""
    df = blank_to_null(df, "gender", " ")
    df = df.where(F.col("age") < max_age)
    df = flags_to_bool(df, ["flag_price_imputed", "flag_qty_imputed"])
    return with_time_parts(df)


def filter_optional(df: DataFrame, state: str | None = None,
                    retailer_type: str | None = None) -> DataFrame:
    """A falsy filter value means no filter."""
    if state:
        df = df.where(F.col("state") == state)
    if retailer_type:
        df = df.where(F.col("retailer_type") == retailer_type)
    return df


def count_cube(df: DataFrame, count_col: str = "receipt_id") -> DataFrame:
    """The counts behind E3-E9 and their filters: per date, hour, state and
    retailer type the rows (``n``) and the non-null ``count_col`` (``n_known``).

    As large as the calendar times the filter values, however many rows there are.
    """
    return df.groupBy(*CUBE_KEYS).agg(F.count(F.lit(1)).alias("n"), F.count(F.col(count_col)).alias("n_known"))


def merged_cube(cubes: DataFrame) -> DataFrame:
    """Cubes of disjoint rows (their union) as the cube of all these rows."""
    return cubes.groupBy(*CUBE_KEYS).agg(F.sum("n").alias("n"), F.sum("n_known").alias("n_known"))


def cube_rows(cube: DataFrame) -> DataFrame:
    """A cube with the date parts that the counts below group by."""
    return cube.withColumns({"month": F.month("date").cast("long"), "dayofweek": F.weekday("date").cast("long")})


def _rows_of(count: str | None, of: Column) -> Column:
    """The rows, or those that the column ``count`` of a cube stands for."""
    return F.sum(count) if count else F.count(of)


def daily_counts(df: DataFrame, months: tuple = MONTHS, count: str | None = None) -> DataFrame:
    """Rows per day in the given months: ``date, month, n``.

    Days without rows produce no row (no zero fill), as in the reference.
    ``count`` names the count of a cube's rows.
    """
    sel = df.where(F.col("month").isin(*months))
    return sel.groupBy("date", "month").agg(_rows_of(count, F.lit(1)).alias("n"))


def daily_band(daily: DataFrame, k: float = BAND_K) -> DataFrame:
    """Each day with the band mean -/+ k * sample std of the daily counts."""
    # One scalar subquery per statistic, attached once as a column (Spark
    # merges the two into one execution); everything else reads the columns.
    stats = daily.agg(F.avg("n").alias("mu"), F.stddev_samp("n").alias("sd"))
    out = daily.select("date", "month", "n", stats.select("mu").scalar().alias("mean"),
                       stats.select("sd").scalar().alias("sd"))
    lo = F.col("mean") - F.col("sd") * k
    hi = F.col("mean") + F.col("sd") * k
    return out.select("date", "month", "n", "mean", "sd", lo.alias("lower"), hi.alias("upper"),
                      ((F.col("n") < lo) | (F.col("n") > hi)).alias("outside_band"))


def week_part(dayofweek: Column) -> Column:
    return F.when(dayofweek <= LAST_WEEKDAY, WEEKDAY).otherwise(WEEKEND)


def weekpart_daily(df: DataFrame, count_col: str = "receipt_id", count: str | None = None) -> DataFrame:
    """E5: non-null ``count_col`` per day, split weekday / weekend (of a cube: ``count``)."""
    return (df.withColumn("part", week_part(F.col("dayofweek")))
              .groupBy("part", "date").agg(_rows_of(count, F.col(count_col)).alias("n")))


def _part_stats(daily: DataFrame) -> DataFrame:
    return daily.groupBy("part").agg(
        F.count("n").alias("n_total"), F.min("n").cast("double").alias("lo"),
        F.max("n").cast("double").alias("hi"), F.stddev_samp("n").alias("sd"))


def weekpart_hist(daily: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """``bins`` equal-width bins from min to max per part, as a density.

    All bins are returned (empty ones with n = 0); the last bin is closed.
    A single-valued part gets the range (v - 0.5, v + 0.5), like numpy.
    """
    st = _part_stats(daily).select(
        "part", "n_total",
        F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("a"),
        F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("b"))
    st = st.withColumn("step", (F.col("b") - F.col("a")) / bins)

    def edge(i: Column) -> Column:
        # numpy.linspace edges: start + i * step, the last edge exactly b.
        return F.when(i >= bins, F.col("b")).otherwise(F.col("a") + i * F.col("step"))

    x = F.col("n").cast("double")
    guess = F.least(F.floor((x - F.col("a")) * (F.lit(float(bins)) / (F.col("b") - F.col("a")))),
                    F.lit(bins - 1)).cast("long")
    # Correct the arithmetic guess against the actual edges, as numpy does.
    fixed = (F.when(x < edge(F.col("g")), F.col("g") - 1)
             .when((x >= edge(F.col("g") + 1)) & (F.col("g") != bins - 1), F.col("g") + 1)
             .otherwise(F.col("g")))
    # Two parts: the statistics side is bounded, broadcast it.
    counted = (daily.join(F.broadcast(st.select("part", "a", "b", "step")), "part")
               .withColumn("g", guess).withColumn("bin", fixed)
               .groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = st.select("part", "n_total", "a", "b", "step",
                     F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")) \
        .withColumn("bin", F.col("bin").cast("long"))
    out = grid.join(counted, ["part", "bin"], "left").fillna(0, ["n"])
    lo_e, hi_e = edge(F.col("bin")), edge(F.col("bin") + 1)
    # numpy: counts / diff(edges) / total
    return out.select("part", "bin", lo_e.alias("bin_lo"), hi_e.alias("bin_hi"), "n",
                      (F.col("n") / (hi_e - lo_e) / F.col("n_total")).alias("density"))


def weekpart_kde(daily: DataFrame, points: int = KDE_POINTS) -> DataFrame:
    """Gaussian KDE of daily counts on ``points`` grid points from min to
    max per part; bandwidth = sample std * N^(-1/5) (Scott's rule).

    Work is linear: distinct daily values (with multiplicity) each add their
    kernel to the fixed grid, summed with map-side partial aggregation. Parts
    with fewer than two days or zero spread have no density and no rows.
    """
    st = _part_stats(daily).where((F.col("n_total") >= 2) & (F.col("sd") > 0))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n_total").cast("double"), F.lit(-0.2)))
    vals = daily.groupBy("part", "n").agg(F.count(F.lit(1)).alias("mult"))
    j = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    grid = vals.join(F.broadcast(st), "part").select("part", "n", "mult", "n_total", "h", "lo", "hi", j)
    x = F.col("lo") + F.col("point") * ((F.col("hi") - F.col("lo")) / (points - 1))
    z = (x - F.col("n")) / F.col("h")
    kern = F.col("mult") * F.exp(z * z * -0.5)
    norm = F.col("n_total") * F.col("h") * math.sqrt(2 * math.pi)
    return (grid.withColumn("x", x)
            .groupBy("part", "point", "x", "n_total", "h")
            .agg(F.sum(kern).alias("k"))
            .select("part", F.col("point").cast("long").alias("point"), "x",
                    (F.col("k") / norm).alias("density")))


def hour_counts(df: DataFrame, count: str | None = None) -> DataFrame:
    """E8 input: rows per (part, date, hour) (of a cube: ``count``)."""
    return (df.withColumn("part", week_part(F.col("dayofweek")))
              .groupBy("part", "date", "hour").agg(_rows_of(count, F.lit(1)).alias("n")))


def hour_pivot(counts: DataFrame) -> DataFrame:
    """One row per (part, date), one column per hour h00..h23; an hour
    without rows stays NULL."""
    hours = list(range(24))
    wide = counts.groupBy("part", "date").pivot("hour", hours).agg(F.sum("n"))
    return wide.select("part", "date", *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])


def hour_box(counts: DataFrame, whis: float = WHISKER) -> DataFrame:
    """Box-plot statistics of the daily counts per (part, hour).

    Quartiles by linear interpolation; whiskers at the most extreme counts
    within ``whis`` * IQR of the box; fliers are the counts beyond them.
    """
    keys = ["part", "hour"]
    q = counts.groupBy(*keys).agg(
        F.percentile(F.col("n").cast("double"), [0.25, 0.5, 0.75]).alias("qs"),
        F.count(F.lit(1)).alias("n_days"), F.avg("n").alias("mean"))
    q = q.select(*keys, "n_days", "mean", F.col("qs")[0].alias("q1"),
                 F.col("qs")[1].alias("med"), F.col("qs")[2].alias("q3"))
    q = q.withColumn("lo_lim", F.col("q1") - (F.col("q3") - F.col("q1")) * whis) \
         .withColumn("hi_lim", F.col("q3") + (F.col("q3") - F.col("q1")) * whis)
    # At most 2 parts x 24 hours: bounded, broadcast. A count lies beyond a
    # whisker exactly when it lies beyond the limit, so one pass suffices.
    j = counts.join(F.broadcast(q), keys)
    n = F.col("n").cast("double")
    return j.groupBy(*keys, "n_days", "mean", "q1", "med", "q3").agg(
        F.min(F.when(n >= F.col("lo_lim"), n)).alias("whislo"),
        F.max(F.when(n <= F.col("hi_lim"), n)).alias("whishi"),
        F.count(F.when((n < F.col("lo_lim")) | (n > F.col("hi_lim")), 1)).alias("n_fliers"))
