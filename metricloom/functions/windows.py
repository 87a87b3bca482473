"""Tumbling windows over integer nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 10**9
#: Fixed value: seconds from the first day of year 1, where windows are counted from, to 1970.
SECONDS_BEFORE_1970 = 62135596800


def nanos(ts: Column) -> Column:
    """Nanoseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.expr("1000L") * F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def whole(nanos: Column, unit: int) -> Column:
    """How many whole units, rounded down; in integers, as doubles can't tell neighbouring nanoseconds apart."""
    x, n = nanos.cast("bigint"), F.lit(unit).cast("bigint")
    return F.call_function("div", x - F.pmod(x, n), n)


def window_start(ts_nanos: Column, resolution_s: Column) -> Column:
    """Start of the window of ``resolution_s`` that holds the time; windows are counted from year 1, so weeks start on Mondays."""
    r = resolution_s.cast("bigint")
    shift = F.lit(SECONDS_BEFORE_1970).cast("bigint") % r
    return ts_nanos - F.pmod(ts_nanos + shift * F.lit(NANOS), r * F.lit(NANOS))


def window_end(ts_nanos: Column, resolution_s: Column) -> Column:
    return window_start(ts_nanos, resolution_s) + resolution_s.cast("bigint") * F.lit(NANOS)
