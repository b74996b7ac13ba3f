import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import temporal


def daily_frame(spark, counts, part="weekday"):
    base = dt.date(2024, 1, 1)
    rows = [(part, base + dt.timedelta(days=i), int(c)) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "part string, date date, n long")


def test_hist_matches_numpy(spark):
    rng = np.random.default_rng(3)
    counts = rng.integers(40, 90, size=57)
    got = temporal.weekpart_hist(daily_frame(spark, counts)).orderBy("bin").collect()
    dens, edges = np.histogram(counts, bins=20, density=True)
    hist, _ = np.histogram(counts, bins=20)
    assert [r.n for r in got] == list(hist)
    assert np.allclose([r.density for r in got], dens, rtol=0, atol=1e-12)
    assert np.allclose([r.bin_lo for r in got], edges[:-1])


def test_hist_single_value(spark):
    got = temporal.weekpart_hist(daily_frame(spark, [5, 5, 5])).orderBy("bin").collect()
    dens, edges = np.histogram(np.array([5, 5, 5]), bins=20, density=True)
    assert np.allclose([r.density for r in got], dens) and math.isclose(got[0].bin_lo, edges[0])


def numpy_kde(x, points=100):
    x = np.asarray(x, dtype=float)
    h = x.std(ddof=1) * len(x) ** (-0.2)
    grid = np.linspace(x.min(), x.max(), points)
    z = (grid[:, None] - x[None, :]) / h
    return grid, np.exp(-0.5 * z * z).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))


def test_kde_matches_gaussian_kde_formula(spark):
    rng = np.random.default_rng(5)
    counts = rng.integers(10, 60, size=40)
    got = temporal.weekpart_kde(daily_frame(spark, counts)).orderBy("point").collect()
    grid, dens = numpy_kde(counts)
    assert len(got) == 100
    assert np.allclose([r.x for r in got], grid, atol=1e-9)
    assert np.allclose([r.density for r in got], dens, rtol=1e-9, atol=1e-15)


def test_kde_degenerate_parts_have_no_rows(spark):
    assert temporal.weekpart_kde(daily_frame(spark, [4, 4, 4])).count() == 0
    assert temporal.weekpart_kde(daily_frame(spark, [4])).count() == 0


def test_box_stats_match_matplotlib_rules(spark):
    rng = np.random.default_rng(9)
    vals = list(rng.integers(0, 30, size=50)) + [200, -50]
    rows = [("weekday", dt.date(2024, 1, 1) + dt.timedelta(days=i), 13, int(v))
            for i, v in enumerate(vals)]
    counts = spark.createDataFrame(rows, "part string, date date, hour long, n long")
    r = temporal.hour_box(counts).first()
    x = np.array(vals, dtype=float)
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    lo, hi = x[x >= q1 - 1.5 * iqr].min(), x[x <= q3 + 1.5 * iqr].max()
    assert (r.q1, r.med, r.q3) == pytest.approx((q1, med, q3))
    assert (r.whislo, r.whishi) == (lo, hi)
    assert r.n_fliers == int(((x < lo) | (x > hi)).sum())
    assert r.n_days == len(vals)


def test_time_parts_and_pivot(spark):
    ev = spark.createDataFrame(
        [("r1", dt.datetime(2024, 1, 6, 23, 59)), ("r2", dt.datetime(2024, 1, 8, 0, 1)),
         ("r3", dt.datetime(2024, 1, 8, 0, 30))], "receipt_id string, created_at_mst timestamp_ntz")
    tp = temporal.with_time_parts(ev).collect()
    assert [r.dayofweek for r in tp] == [5, 0, 0]         # Saturday = 5, Monday = 0
    piv = {r.date: r for r in temporal.hour_pivot(temporal.hour_counts(temporal.with_time_parts(ev))).collect()}
    monday = piv[dt.date(2024, 1, 8)]
    assert monday.part == "weekday" and monday.h00 == 2 and monday.h01 is None
    assert piv[dt.date(2024, 1, 6)].part == "weekend"


def test_daily_band(spark):
    counts = [10, 12, 11, 40, 9, 10]
    band = temporal.daily_band(daily_frame(spark, counts).withColumn("month", F.lit(9))).collect()
    mu, sd = np.mean(counts), np.std(counts, ddof=1)
    assert math.isclose(band[0].mean, mu) and math.isclose(band[0].sd, sd)
    assert sum(r.outside_band for r in band) == sum(1 for c in counts if c < mu - 1.5 * sd or c > mu + 1.5 * sd)
