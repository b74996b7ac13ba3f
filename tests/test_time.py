import datetime as dt

from pyspark.sql import functions as F

from tillroll.functions.timecols import completed_years, instant_from_utc_wallclock, wallclock_at_offset


def test_completed_years_edges(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 29),), (dt.date(2001, 5, 1),), (None,)], "b date")
    got = [r.a for r in df.select(completed_years("b", "2001-02-28").alias("a")).collect()]
    assert got == [0, 0, None]
    got = [r.a for r in df.select(completed_years("b", "2001-03-01").alias("a")).collect()]
    assert got[0] == 1


def test_mst_shift_is_session_independent(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 9, 1, 3, 0),)], "t timestamp_ntz")
    expr = wallclock_at_offset(instant_from_utc_wallclock("t"), "-07:00").alias("m")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert df.select(expr).first().m == dt.datetime(2016, 8, 31, 20, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_repeated_local_hours_stay_apart(spark):
    """Both hours that New York repeats on 2016-11-06, whatever the session zone."""
    df = spark.createDataFrame([(dt.datetime(2016, 11, 6, 5, 30),), (dt.datetime(2016, 11, 6, 6, 30),),
                                (dt.datetime(2016, 3, 13, 10, 30),)], "t timestamp_ntz")
    expr = wallclock_at_offset(instant_from_utc_wallclock("t"), "-07:00").alias("m")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York", "America/Denver"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert [r.m for r in df.select(expr).collect()] == [
                dt.datetime(2016, 11, 5, 22, 30), dt.datetime(2016, 11, 5, 23, 30),
                dt.datetime(2016, 3, 13, 3, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
