"""Column expressions on instants. Durations are whole microseconds until the last step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR

# Fixed value: buckets are counted from Monday 2000-01-03 00:00 UTC.
_BUCKET_ORIGIN = 946_857_600 * SECOND


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts))


def elapsed(start: str | Column, end: str | Column) -> Column:
    """Microseconds from start to end."""
    return micros(end) - micros(start)


def time_bucket(ts: str | Column, step_seconds: float) -> Column:
    """Start of the fixed-width bucket an instant falls into."""
    us, step = micros(ts), int(step_seconds * SECOND)
    return F.timestamp_micros(us - F.pmod(us - F.lit(_BUCKET_ORIGIN), F.lit(step)))


def day_of(ts: str | Column) -> Column:
    return F.date_trunc("day", col(ts))


def between(ts: str | Column, t_from, t_to) -> Column:
    """Time range of a panel, both ends included; reaches the scan as a pushed filter."""
    return (col(ts) >= F.lit(t_from).cast("timestamp")) & (col(ts) <= F.lit(t_to).cast("timestamp"))


def whole(value: str | Column, kind: str = "int") -> Column:
    """Round a double half to even and cast (a plain cast would truncate)."""
    return F.rint(col(value)).cast(kind)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is zero or missing."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))
