"""Date and time column helpers, independent of the session time zone."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant_from_utc_wallclock(ntz: Column | str) -> Column:
    """A timestamp_ntz read as UTC wall-clock time -> timestamp (instant).

    The text carries its own zone, so the session zone plays no part."""
    text = F.concat(_c(ntz).cast("timestamp_ntz").cast("string"), F.lit("Z"))
    return text.cast("timestamp")


def wallclock_at_offset(instant: Column | str, zone: str = "-07:00") -> Column:
    """``ts AT TIME ZONE zone``: the wall-clock time (timestamp_ntz) in ``zone``.

    The instant's own microseconds are added to the UTC epoch and shifted from
    there. No wall-clock time of the session zone occurs on the way, so hours
    that a daylight-saving change repeats or skips there stay apart.
    """
    seconds = (F.unix_micros(_c(instant)).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")
               ).cast("decimal(18,6)")
    zero = F.lit(0)
    since = F.make_dt_interval(zero, zero, zero, seconds)
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def completed_years(birth: Column | str, as_of: str | _dt.date) -> Column:
    """Completed years between ``birth`` and ``as_of`` (bigint).

    Same value as ``date_part('year', age(as_of, birth))``: a 29 Feb birthday
    completes a year on 1 Mar in non-leap years; negative when born later.
    ``floor(months_between / 12)`` differs on those edges and is not used.
    """
    day = as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(as_of)
    return F.timestamp_diff("YEAR", _c(birth), F.lit(day))
