"""Wire formats that queries carry: delta-coded integer lists; and a hash bucket's number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value of the format: a run of deltas ends before a value this far from its base.
MAX_DELTA = 65535


def _write(value: int, out: bytearray) -> None:
    value &= 0xFFFFFFFF
    while True:
        low, value = value & 0x7F, value >> 7
        out.append(low | (0x80 if value else 0))
        if not value:
            return


def _read(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if shift >= 35 or at >= len(data):
            raise ValueError("corrupted data")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if not byte & 0x80:
            value &= 0xFFFFFFFF
            return (value - (1 << 32) if value >> 31 else value), at


def delta_encode(values: list[int], width: int = 8) -> bytes:
    """Sorted values as runs of base, number of deltas, deltas, in varints; 8-byte bases as two halves."""
    rest, out, at = sorted(values), bytearray(), 0
    while at < len(rest):
        base, end = rest[at], at + 1
        while end < len(rest) and rest[end] - base < MAX_DELTA:
            end += 1
        if width == 8:
            _write(base >> 32, out)
        _write(base, out)
        _write(end - at - 1, out)
        for v in rest[at + 1 : end]:
            _write(v - base, out)
        at = end
    return bytes(out)


def delta_decode(data: bytes, width: int = 8) -> list[int]:
    out, at = [], 0
    while at < len(data):
        high = 0
        if width == 8:
            high, at = _read(data, at)
        low, at = _read(data, at)
        base = (high << 32) | (low & 0xFFFFFFFF) if width == 8 else low
        runs, at = _read(data, at)
        out.append(base)
        for _ in range(runs):
            delta, at = _read(data, at)
            out.append(base + delta)
    return out


def hash_bucket(value: Column, buckets: int) -> Column:
    """The bucket of a BIGINT in a table bucketed by Spark."""
    return F.pmod(F.hash(value.cast("long")), F.lit(buckets))
