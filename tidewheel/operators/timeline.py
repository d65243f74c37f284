"""Timelines: buckets of time from the start of the asked range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.timefns import round_time
from ..schema import TIME

AUTO_BUCKETS = 100


@dataclass(frozen=True)
class Buckets:
    window: int
    count: int


def buckets(start: int, end: int, window: int = 0) -> Buckets:
    """How a range is cut: at ``window`` seconds, or into about 100 buckets, of a second at least."""
    span = end - start
    if span <= 0:
        raise ValueError("a timeline ends after its start")
    n = AUTO_BUCKETS if window == 0 else span // window
    if n == 0 or n > span:
        n = span
    return Buckets(span // n, n)


def window_column(start: int, end: int, window: int = 0, time_unit: int = 0, tz_offset_minutes: int = 0, time: str = TIME) -> Column:
    """Seconds from ``start`` to the beginning of a row's bucket: of a calendar unit, or of a fixed width. A single bucket is 0."""
    cut = buckets(start, end, window)
    if cut.count < 2:
        return F.lit(0).cast("long")
    if time_unit:
        return round_time(F.col(time), time_unit, tz_offset_minutes, start)
    return (F.expr(f"(`{time}` - {int(start)}L) div {int(cut.window)}L") * F.lit(cut.window)).cast("long")
