"""Messages in Thrift's binary protocol as columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..schema import TIME

#: A nested field's id is its parent's times this, plus its own.
LEVEL = 1000
STOP, BOOL, BYTE, DOUBLE, I16, I32, I64, STRING, STRUCT, MAP, SET, LIST = 0, 2, 3, 4, 6, 8, 10, 11, 12, 13, 14, 15
_FIXED = {BOOL: ("?", 1), BYTE: ("b", 1), DOUBLE: (">d", 8), I16: (">h", 2), I32: (">i", 4), I64: (">q", 8)}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def unpack(self, form: str, size: int):
        if self.at + size > len(self.data):
            raise ValueError("the message ends too early")
        value = struct.unpack_from(form, self.data, self.at)[0]
        self.at += size
        return value

    def text(self) -> bytes:
        size = self.unpack(">i", 4)
        if size < 0 or self.at + size > len(self.data):
            raise ValueError("the message ends too early")
        self.at += size
        return self.data[self.at - size : self.at]

    def skip(self, kind: int) -> None:
        if kind in _FIXED:
            self.unpack(*_FIXED[kind])
        elif kind == STRING:
            self.text()
        elif kind == STRUCT:
            while (inner := self.unpack("b", 1)) != STOP:
                self.unpack(">h", 2)
                self.skip(inner)
        elif kind in (LIST, SET):
            inner, n = self.unpack("b", 1), self.unpack(">i", 4)
            for _ in range(n):
                self.skip(inner)
        elif kind == MAP:
            key, value, n = self.unpack("b", 1), self.unpack("b", 1), self.unpack(">i", 4)
            for _ in range(n):
                self.skip(key)
                self.skip(value)
        else:
            raise ValueError(f"unknown field type {kind}")

    def fields(self, base: int, wanted: Mapping[int, str], out: dict) -> None:
        while (kind := self.unpack("b", 1)) != STOP:
            number = self.unpack(">h", 2) + base
            name = wanted.get(number)
            if name is not None and name not in out and kind in _FIXED:
                out[name] = self.unpack(*_FIXED[kind])
            elif name is not None and name not in out and kind == STRING:
                out[name] = self.text().decode("utf-8", "replace")
            elif name is not None and name not in out and kind in (LIST, SET):
                inner, n = self.unpack("b", 1), self.unpack(">i", 4)
                for _ in range(n):
                    self.skip(inner)
                out[name] = n
            elif kind == STRUCT:
                self.fields(number * LEVEL, wanted, out)
            else:
                self.skip(kind)


def decode(message: bytes, columns: Mapping[str, int]) -> dict:
    """Named fields of a message: by id, nested ones by parent * 1000 + child. Lists read as their size."""
    out: dict = {}
    _Reader(message).fields(0, {n: c for c, n in columns.items()}, out)
    if isinstance(out.get(TIME), int):
        while out[TIME] > 10**11:  # milliseconds or finer
            out[TIME] //= 1000
    return out


def of_thrift(df: DataFrame, column: str, schema: T.StructType, columns: Mapping[str, int], keep: Sequence[str] = ()) -> DataFrame:
    """Columns out of a binary column. Fields that a message lacks are null; a message that can't be read gives nulls."""
    kept = [f for f in df.schema if f.name in keep]
    target = T.StructType([*kept, *schema])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for message in pdf[column]:
                try:
                    rows.append(decode(bytes(message), columns) if message is not None else {})
                except (ValueError, struct.error):
                    rows.append({})
            got = pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in schema})
            yield pd.concat([pdf[[f.name for f in kept]].reset_index(drop=True), got], axis=1)

    return df.select(*keep, column).mapInPandas(run, target)
