"""Arithmetic whose result has the wider of the operands' kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import is_integer, result_kind

#: Bits of each integer kind.
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _wrapped(value: Column, kind: T.DataType) -> Column:
    """A whole number (decimal) reduced to a kind's range in two's complement."""
    span = 1 << _BITS[type(kind)]
    low = F.pmod(value, F.lit(str(span)).cast("decimal(38,0)"))
    half = F.lit(str(span // 2)).cast("decimal(38,0)")
    return F.when(low >= half, low - F.lit(str(span)).cast("decimal(38,0)")).otherwise(low).cast(kind)


def combine(op: str, left: Column, left_kind: T.DataType, right: Column, right_kind: T.DataType) -> tuple[Column, T.DataType]:
    """``left op right`` and its kind. Integers wrap around on overflow; division by zero gives null."""
    kind = result_kind(left_kind, right_kind)
    if op == "%" and not is_integer(kind):
        raise TypeError("% takes integers")
    if op in "/%":
        divisor = F.nullif(right, F.lit(0).cast(right_kind))
        if not is_integer(kind):
            return (left / divisor).cast(kind), kind
        # the least number divided by -1 has no counterpart in its kind: wide enough first, then wrapped
        wide = "decimal(20,0)" if isinstance(kind, T.LongType) else "long"
        a, b = left.cast(wide), divisor.cast(wide)
        if op == "%":
            return (a % b).cast(kind), kind
        return (_wrapped(F.call_function("div", a, b).cast("decimal(38,0)"), kind) if wide != "long" else _narrow(F.call_function("div", a, b), kind)), kind
    if not is_integer(kind):
        a, b = left.cast(kind), right.cast(kind)
        out = a + b if op == "+" else a - b if op == "-" else a * b
        return out.cast(kind), kind
    if isinstance(kind, T.LongType):
        a, b = left.cast("decimal(19,0)"), right.cast("decimal(19,0)")
        out = a + b if op == "+" else a - b if op == "-" else a * b
        plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](left.cast("long"), right.cast("long"))
        return F.coalesce(plain, _wrapped(out.cast("decimal(38,0)"), kind)), kind
    a, b = left.cast("long"), right.cast("long")
    return _narrow(a + b if op == "+" else a - b if op == "-" else a * b, kind), kind


def _narrow(value: Column, kind: T.DataType) -> Column:
    """A long reduced to a narrower kind in two's complement."""
    if isinstance(kind, T.LongType):
        return value
    shift = 64 - _BITS[type(kind)]
    return F.shiftright(F.shiftleft(value, shift), shift).cast(kind)
