"""Clock columns.

Operators keep time as whole seconds since the epoch (BIGINT, UTC).  Integer
clocks make range frames, shifted equi-joins and bin arithmetic exact and
cheap; ``to_clock`` / ``from_clock`` convert at the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60
HOUR = 3600
DAY = 86400


def to_clock(ts: Column | str) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(1_000_000)).cast("bigint")


def from_clock(t: Column | str) -> Column:
    col = F.col(t) if isinstance(t, str) else t
    return F.timestamp_seconds(col)


def floor_to(t: Column | str, step: int) -> Column:
    col = F.col(t) if isinstance(t, str) else t
    return col - F.pmod(col, F.lit(step))


def month_start(t: Column | str) -> Column:
    return F.unix_timestamp(F.date_trunc("month", from_clock(t)))


def month_end(t: Column | str) -> Column:
    return F.unix_timestamp(F.add_months(F.date_trunc("month", from_clock(t)), 1).cast("timestamp"))


def month_key(t: Column | str) -> Column:
    return F.date_format(from_clock(t), "yyyy-MM")


def month_elapsed(t: Column | str) -> Column:
    """Fraction of the calendar month that has passed at ``t``."""
    col = F.col(t) if isinstance(t, str) else t
    return (col - month_start(t)) / (month_end(t) - month_start(t))
