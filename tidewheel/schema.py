"""Declared schemas, their kinds, and how kinds combine."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import types as T

TIME = "_time_"
WINDOW = "_window_"

#: Type names of the schema notation, in lower case.
ALIASES = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "tinyint": T.ByteType(), "byte": T.ByteType(), "char": T.ByteType(),
    "smallint": T.ShortType(), "short": T.ShortType(),
    "int": T.IntegerType(), "integer": T.IntegerType(),
    "bigint": T.LongType(), "long": T.LongType(),
    "real": T.FloatType(), "float": T.FloatType(),
    "double": T.DoubleType(), "decimal": T.DoubleType(),
    "int128": T.DecimalType(38, 0),
    "varchar": T.StringType(), "string": T.StringType(), "binary": T.StringType(),
}
LISTS, MAPS, STRUCTS = ("array", "list", "vector"), ("map", "dictionary"), ("row", "struct")

#: Numeric kinds from narrow to wide; the result of arithmetic is the wider one.
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
INTEGERS = NUMERIC[:4]

_token = re.compile(r"\s*([A-Za-z_][\w.$-]*|[<>:,])")


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            found = _token.match(text, at)
            if not found:
                raise ValueError(f"unexpected {text[at:at + 10]!r} in schema")
            self.tokens.append(found[1])
            at = found.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.at = 0

    def take(self, wanted: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise ValueError("schema ends too early")
        got = self.tokens[self.at]
        if wanted is not None and got != wanted:
            raise ValueError(f"{wanted!r} expected in schema, not {got!r}")
        self.at += 1
        return got

    def struct(self) -> T.StructType:
        self.take("<")
        fields = []
        while True:
            name = self.take()
            self.take(":")
            fields.append(T.StructField(name, self.type(), True))
            if self.take() == ">":
                break
            if self.tokens[self.at - 1] != ",":
                raise ValueError("',' or '>' expected in schema")
        names = [f.name for f in fields]
        if len(set(names)) < len(names):
            raise ValueError("a schema has two columns of one name")
        return T.StructType(fields)

    def type(self) -> T.DataType:
        name = self.take().lower()
        if name in ALIASES:
            return ALIASES[name]
        if name in LISTS:
            self.take("<")
            item = self.type()
            if isinstance(item, T.ArrayType | T.MapType | T.StructType):
                raise ValueError("list items must be scalar")
            self.take(">")
            return T.ArrayType(item)
        if name in MAPS:
            self.take("<")
            key = self.type()
            self.take(",")
            value = self.type()
            self.take(">")
            return T.MapType(key, value)
        if name in STRUCTS:
            raise ValueError("a struct inside a struct can't be stored")
        raise ValueError(f"unknown type {name!r}")


def parse_schema(text: str) -> T.StructType:
    """``ROW<name:type, ...>`` as a StructType. Type names are case-insensitive."""
    parser = _Parser(text)
    if parser.take().lower() not in STRUCTS:
        raise ValueError("a schema is ROW<...>")
    out = parser.struct()
    if parser.at < len(parser.tokens):
        raise ValueError("text after the schema's end")
    return out


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS)


def result_kind(left: T.DataType, right: T.DataType) -> T.DataType:
    """The wider of two numeric kinds."""
    if not (is_numeric(left) and is_numeric(right)):
        raise TypeError(f"no arithmetic between {left.simpleString()} and {right.simpleString()}")
    order = {k: i for i, k in enumerate(NUMERIC)}
    return left if order[type(left)] >= order[type(right)] else right


def zero(kind: T.DataType):
    """What stands for null where nulls read as defaults."""
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, T.FloatType | T.DoubleType):
        return 0.0
    if isinstance(kind, T.DecimalType):
        return Decimal(0)
    if isinstance(kind, T.StringType):
        return ""
    return 0 if is_integer(kind) else None


def is_metric(kind: T.DataType) -> bool:
    """Scalars but strings are metrics; strings are dimensions; compounds are neither."""
    return is_numeric(kind) or isinstance(kind, T.BooleanType | T.DecimalType)
