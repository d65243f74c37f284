"""Time: rounding to calendar units, relative literals, strptime patterns."""

from __future__ import annotations

import re
import time as clock
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calendar units by number, from 1, and the units of relative literals in seconds.
UNITS = ("hour", "day", "week", "month", "quarter", "year")
SECONDS = {"minute": 60, "minutes": 60, "min": 60, "mins": 60, "m": 60, "hour": 3600, "hours": 3600, "hr": 3600, "hrs": 3600, "h": 3600, "day": 86400, "days": 86400, "d": 86400, "week": 604800, "weeks": 604800, "wk": 604800, "wks": 604800, "w": 604800}


def unit_name(unit: int | str) -> str:
    """A calendar unit by its number (1 hour to 6 year) or name."""
    if isinstance(unit, int):
        if not 1 <= unit <= len(UNITS):
            raise ValueError(f"time unit {unit} isn't one of 1 to {len(UNITS)}")
        return UNITS[unit - 1]
    if unit not in UNITS:
        raise ValueError(f"time unit {unit!r} isn't one of {UNITS}")
    return unit


def round_time(seconds: Column, unit: int | str, tz_offset_minutes: int = 0, begin: Column | int = 0) -> Column:
    """Epoch seconds rounded down to a unit in UTC, as seconds from ``begin``, 0 at least. Weeks begin on Sunday.

    Hours and days are plain arithmetic; longer units go by the calendar, whatever the session's time zone.
    """
    name = unit_name(unit)
    local = seconds.cast("long") - F.lit(tz_offset_minutes * 60)
    day = F.floor(local / 86400).cast("long")
    if name == "hour":
        rounded = local - F.pmod(local, F.lit(3600))
    elif name == "day":
        rounded = day * 86400
    elif name == "week":
        rounded = (day - F.pmod(day + 4, F.lit(7))) * 86400  # day 0 was a Thursday
    else:
        rounded = F.unix_date(F.trunc(F.date_from_unix_date(day.cast("int")), name)).cast("long") * 86400
    return F.greatest(F.lit(0).cast("long"), rounded - (begin if isinstance(begin, Column) else F.lit(begin)))


def parse_time(literal: str | int | float | None, now: float | None = None) -> int:
    """A time literal as epoch seconds: milliseconds since the epoch, ``now``, ``-3days`` and the like, or a date in UTC."""
    if literal is None:
        return 0
    now = clock.time() if now is None else now
    text = str(literal).strip()
    try:
        return round(float(text) / 1000)
    except ValueError:
        pass
    low = text.lower()
    if "now" in low:
        return round(now)
    found = re.search(r"-(\d+)([a-z]\w*)", low)
    if found and found[2] in SECONDS:
        return round(now - int(found[1]) * SECONDS[found[2]])
    for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y"):
        try:
            return int(datetime.strptime(text.removesuffix(" UTC"), form).replace(tzinfo=timezone.utc).timestamp())
        except ValueError:
            continue
    try:
        when = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"{literal!r} isn't a time") from None
    return int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp())


#: Strptime directives and Spark's pattern letters for them.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "j": "DDD", "z": "Z", "Z": "z", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm"}


def spark_pattern(pattern: str) -> str:
    """A strptime pattern as a Spark one."""
    out, plain = [], []

    def flush() -> None:
        if plain:
            out.append("'" + "".join(plain).replace("'", "''") + "'")
            plain.clear()

    at = 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "%" and at + 1 < len(pattern):
            at += 1
            if pattern[at] == "%":
                plain.append("%")
            elif pattern[at] in DIRECTIVES:
                flush()
                out.append(DIRECTIVES[pattern[at]])
            else:
                raise ValueError(f"%{pattern[at]} isn't supported in a time pattern")
        elif ch.isalpha() or ch in "'[]{}#":
            plain.append(ch)
        else:
            flush()
            out.append(ch)
        at += 1
    flush()
    return "".join(out)


def wall_seconds(time: Column) -> Column:
    """Epoch seconds of a timestamp's wall clock, read as UTC whatever the session's time zone."""
    since = time.cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return since.cast("interval second").cast("long")


#: Patterns of unix times, and their steps in a second.
SCALES = {"UNIXTIME": 1, "UNIXTIME_MS": 1000, "UNIXTIME_NANO": 1_000_000_000}
#: Days from a spreadsheet's serial number 0 to the epoch.
SERIAL_EPOCH = 25569


def time_column(column: Column, pattern: str) -> Column:
    """Epoch seconds from a column: unix time in some scale, a serial number, iso8601, or a strptime pattern.

    A null time is 1; one that can't be read is 0.
    """
    if pattern.upper() in SCALES:
        value = F.call_function("div", column.try_cast("long"), F.lit(SCALES[pattern.upper()]).cast("long"))
    elif pattern.upper() == "SERIAL_NUMBER":
        value = F.round((column.try_cast("double") - SERIAL_EPOCH) * 86400).cast("long")
    elif pattern.lower() == "iso8601":
        text = column.cast("string")  # without a zone of its own, a time is in UTC
        value = F.unix_seconds(F.when(text.rlike(r"(?i)(Z|[+-]\d\d:?\d\d)$") & text.contains(":"), text).otherwise(F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.when(text.contains(":"), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))).try_cast("timestamp"))
    else:
        when = F.try_to_timestamp(column.cast("string"), F.lit(spark_pattern(pattern)))
        value = F.unix_seconds(when) if "%z" in pattern or "%Z" in pattern else wall_seconds(when)
    return F.when(column.isNull(), F.lit(1)).otherwise(F.coalesce(value, F.lit(0))).cast("long")
