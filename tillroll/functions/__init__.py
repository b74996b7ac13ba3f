"""Column-level helpers: exact decimal rounding, shares, ages, zone shifts."""

from tillroll.functions.numeric import (  # noqa: F401
    DEC, exact_mean, rounded_ratio_pct, units_to_decimal,
)
from tillroll.functions.timecols import (  # noqa: F401
    completed_years, instant_from_utc_wallclock, wallclock_at_offset,
)
