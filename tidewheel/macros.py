"""Path macros: ``{date} {hour} {minute} {second}`` or ``{timestamp}``, and custom ones."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From coarse to fine; each needs all before it.
PARTS = ("date", "hour", "minute", "second")
GRANULARITY = ("DAILY", "HOURLY", "MINUTELY", "SECONDLY")
STEP = {"DAILY": 86400, "HOURLY": 3600, "MINUTELY": 60, "SECONDLY": 1}
FORMATS = {"date": "%Y-%m-%d", "hour": "%H", "minute": "%M", "second": "%S"}


def decoded(path: str) -> str:
    """Braces that a URL has encoded."""
    return re.sub(r"%7b(.*?)%7d", r"{\1}", path, flags=re.I)


def _uses(path: str, name: str) -> bool:
    return re.search(r"\{" + name + r"\}", path, re.I) is not None


def granularity(path: str) -> str:
    """What a path's time macros resolve: a granularity, TIMESTAMP, NONE, or INVALID for a macro without its parents."""
    path = decoded(path)
    used = [_uses(path, p) for p in PARTS]
    if _uses(path, "timestamp"):
        return "INVALID" if any(used) else "TIMESTAMP"
    if not any(used):
        return "NONE"
    depth = sum(used)
    return GRANULARITY[depth - 1] if all(used[:depth]) else "INVALID"


def materialize(kind: str, path: str, time: int) -> str:
    """Fill in the time macros that a granularity covers; others stay."""
    path = decoded(path)
    if kind == "TIMESTAMP":
        return re.sub(r"\{timestamp\}", str(time), path, flags=re.I)
    if kind not in GRANULARITY:
        return path
    when = datetime.fromtimestamp(time, timezone.utc)
    for part in PARTS[: GRANULARITY.index(kind) + 1]:
        path = re.sub(r"\{" + part + r"\}", when.strftime(FORMATS[part]), path, flags=re.I)
    return path


def watermark(kind: str, time: int) -> int:
    """The beginning of the granularity's step that a time is in."""
    return time - time % STEP[kind] if kind in STEP else time


def roll(path: str, now: int, max_seconds: float) -> Iterator[tuple[str, int]]:
    """Paths from now back through the retention, with their watermarks; the current step first."""
    kind = granularity(path)
    if kind not in STEP:
        raise ValueError(f"a rolling path needs date macros, and {path!r} is {kind}")
    at = watermark(kind, now)
    while at >= now - max_seconds:
        yield materialize(kind, path, at), at
        at -= STEP[kind]


def wildcards(path: str) -> str:
    """The path with its time macros as wildcards."""
    return re.sub(r"\{(date|hour|minute|second)\}", "*", decoded(path), flags=re.I)


def time_of_path(template: str, file: Column) -> Column:
    """The watermark in a file's path: what stands where the template has its time macros. Custom macros may be any text."""
    template = decoded(template)
    shapes = {"date": r"(\d{4}-\d\d-\d\d)"} | dict.fromkeys(PARTS[1:], r"(\d\d)")
    first = re.search(r"\{(?:date|hour|minute|second)\}", template, re.I).start()
    tail = template[template.rfind("/", 0, first) + 1 :]  # what is before may be written another way
    pattern, order = "/", []
    for part in re.split(r"(\{[^{}]*\})", tail):
        name = part[1:-1].lower()
        if part.startswith("{") and name in shapes:
            pattern += shapes[name]
            order.append(name)
        else:
            pattern += "[^/]*" if part.startswith("{") else ".*".join("\\Q" + x + "\\E" if x else "" for x in part.split("*"))
    get = lambda n: F.regexp_extract(F.url_decode(file), pattern, order.index(n) + 1) if n in order else F.lit("00")
    day = F.unix_date(F.try_to_date(get("date"))).cast("long") * 86400
    return day + get("hour").cast("int") * 3600 + get("minute").cast("int") * 60 + get("second").cast("int")


def expand(path: str, macros: Mapping[str, Sequence[str]]) -> Iterator[tuple[str, dict[str, str]]]:
    """Each combination of the custom macros that the path uses, and the path with them."""
    path = decoded(path)
    used = [n for n in macros if _uses(path, re.escape(n))]
    for values in itertools.product(*(macros[n] for n in used)):
        out = path
        for n, value in zip(used, values, strict=True):
            out = re.sub(r"\{" + re.escape(n) + r"\}", lambda _, value=value: value, out, flags=re.I)
        yield out, dict(zip(used, values, strict=True))
