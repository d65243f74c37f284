"""CSV, JSON and Parquet files. Paths may be on any file system that Hadoop knows."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import CsvProps, JsonProps
from .convert import from_text, headers, or_zero

Paths = str | Sequence[str]


def _heads(spark: SparkSession, paths: Paths, count: int) -> list[tuple[str | list[str], list[str]]]:
    """The first ``count`` lines, blank ones aside, of each file that has one: (path, lines).

    Of a single file one task reads one line after the other; of many, one pass over the texts gives all.
    """
    texts = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    if len(texts.inputFiles()) <= 1:
        found = [r[0].lstrip("\ufeff") for r in texts.where(F.trim("value") != "").limit(count).collect()]
        return [(paths if isinstance(paths, str) else list(paths), found)] if found else []
    rest = texts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value").where("start = 0 and trim(value) <> ''")
    heads: dict[str, list[str]] = {}
    last = None
    for _ in range(count):
        left = rest if last is None else rest.join(F.broadcast(last), "file").where("at > before")
        row = left.groupBy("file").agg(F.min(F.struct("at", "value")).alias("row"))
        found = row.select("file", "row.at", "row.value").collect()
        for r in found:
            heads.setdefault(r["file"], []).append(r["value"].lstrip("\ufeff"))
        last = spark.createDataFrame([(r["file"], r["at"]) for r in found], "file string, before long")
    return [(re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(f)), lines) for f, lines in sorted(heads.items())]


def read_csv(spark: SparkSession, paths: Paths, schema: T.StructType | None = None, props: CsvProps = CsvProps()) -> DataFrame:  # noqa: B008
    """CSV with RFC 4180 quoting, which may span lines.

    Each file's headers are normalized and matched by name; without headers, columns go by their place. Files of equal headers are read
    together. Without a schema, all headers of all files are read as texts. Nothing is null: what can't be read is its kind's zero. Records
    without a cell for the last wanted column of their file are dropped; those with more cells stay.
    """
    groups: dict[tuple, list] = {}
    for path, lines in _heads(spark, paths, props.has_header + props.has_meta or 1):
        cells = [next(csv.reader([x], delimiter=props.delimiter), []) for x in lines]
        names = tuple(headers(cells[0])) if props.has_header else ()
        meta = tuple(cells[props.has_header]) if props.has_meta and len(cells) > props.has_header else ()
        found = groups.setdefault((names, meta), [0, []])
        found[0] = max(found[0], len(cells[0]))
        found[1] += [path] if isinstance(path, str) else path
    if not groups:  # no file has a line
        groups[((), ())] = [0, [paths] if isinstance(paths, str) else list(paths)]
    width = max(n for n, _ in groups.values())
    parts = []
    for (names, meta), (_, files) in groups.items():
        if not props.has_header:
            names = tuple(schema.names) if schema is not None else tuple(f"col_{i}" for i in range(width))
        parts.append(_of_csv(spark, files, list(names), meta, schema, props))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=schema is None)
    return out if schema is not None else out.fillna("")


def _of_csv(spark: SparkSession, paths: list[str], names: list[str], meta: tuple[str, ...], schema: T.StructType | None, props: CsvProps) -> DataFrame:
    """Files of the columns ``names``."""
    missing = [f.name for f in schema or () if f.name not in names]
    if missing:
        raise ValueError(f"{paths[0]!r} has no column {missing[0]!r}")
    read = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__record"]])
    # without pruning, so that a record of another number of cells than the columns is always marked
    reader = spark.read.schema(read).options(header=props.has_header, enforceSchema=True, sep=props.delimiter, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="__record", columnPruning=False, nullValue="\u0000", emptyValue="")
    if props.compression:
        reader = reader.option("compression", props.compression)
    good = reader.csv(paths)
    wanted = max((names.index(n) for n in (schema.names if schema is not None else names)), default=-1) + 1
    if 0 < wanted:
        sep = re.escape(props.delimiter)
        bare = F.regexp_replace("__record", f'(^|{sep})"[^"]*+(?:""[^"]*+)*+"', "$1")
        good = good.where(F.col("__record").isNull() | F.col(f"`{names[wanted - 1]}`").isNotNull() | (F.size(F.split(bare, sep, -1)) >= wanted))
    if meta:  # a second line that describes the columns: the first record of each file
        same = F.lit(True)
        for n, value in zip(names, meta, strict=False):
            same = same & (F.coalesce(F.col(f"`{n}`"), F.lit("")) == F.lit(value))
        good = good.where(~same)
    if schema is None:
        return good.select(*(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))
    return good.select(*(from_text(F.col(f"`{f.name}`"), f.dataType, formatted=True).alias(f.name) for f in schema))


def _path(name: str) -> str:
    """A column's dotted name as a JSON path."""
    return "$" + "".join(f"['{p}']" for p in name.split("."))


def _parsed(df: DataFrame, document: str) -> DataFrame:
    """The text column parsed once, as ``__v``; null where it is no JSON."""
    return df.withColumn("__v", F.try_parse_json(F.col(document)))


def _of_json(schema: T.StructType, columns_map: Mapping[str, str]) -> list:
    """Columns out of the parsed ``__v``. Missing and null values, and those that can't be read, are zeros."""
    lower = {k.lower(): v for k, v in columns_map.items()}
    out = []
    for f in schema:
        path = _variant_path(lower.get(f.name.lower(), f.name))
        value = F.try_variant_get("__v", path, f.dataType.simpleString())
        if isinstance(f.dataType, T.StringType):  # only a JSON string is a string; other values are empty
            value = F.when(F.schema_of_variant(F.try_variant_get("__v", path, "variant")) == "STRING", value)
        elif isinstance(f.dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType):  # also a text like "3.7"
            value = F.coalesce(value, F.try_variant_get("__v", path, "double").try_cast(f.dataType))
        out.append(or_zero(value, f.dataType).alias(f.name))
    return out


def _variant_path(name: str) -> str:
    return "$" + "".join('["' + p + '"]' for p in name.split("."))


def read_json(spark: SparkSession, paths: Paths, schema: T.StructType, props: JsonProps = JsonProps()) -> DataFrame:  # noqa: B008
    """JSON: an object per line; or, with ``rows_field``, documents whose root (``[ROOT]``) or field is an array of objects. A file may hold
    several documents, each from a new line on.

    Dotted names are paths. ``columns_map`` renames columns, case-insensitively: column to path. Lines that are no JSON, or repeat a key in
    one object, give rows of zeros. Each line is parsed once.
    """
    wanted = list(paths) if not isinstance(paths, str) else paths
    if not props.rows_field:
        lines = spark.read.text(wanted).where(F.trim("value") != "").withColumnRenamed("value", "__doc")
    else:
        # within a document, no line ends between a closing and an opening bracket without a comma
        whole = spark.read.text(wanted, wholetext=True).select(F.explode(F.split("value", r"(?<=[}\]])[ \t\r]*\n\s*(?=[{\[])")).alias("value"))
        rows = F.col("value") if props.rows_field == "[ROOT]" else F.get_json_object("value", _path(props.rows_field))
        lines = whole.select(F.explode(F.from_json(rows, "array<string>")).alias("__doc"))
    return _parsed(lines, "__doc").select(*_of_json(schema, props.columns_map))


def of_json_texts(df: DataFrame, column: str, schema: T.StructType, columns_map: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Columns out of JSON texts that a frame already has, such as messages."""
    return _parsed(df, column).select(*keep, *_of_json(schema, columns_map or {}))


def read_parquet(spark: SparkSession, paths: Paths, schema: T.StructType | None = None) -> DataFrame:
    """Parquet by column names. Declared columns must be there; values are converted, also between texts and numbers, and what can't be
    converted is null."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if schema is None:
        return df
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema if f.name not in have]
    if missing:
        raise ValueError(f"the file has no column {missing[0]!r}")
    # a column of the declared type is read as it is, so that filters on it reach the file
    return df.select(*(F.col(f"`{f.name}`") if have[f.name] == f.dataType else F.col(f"`{f.name}`").cast("string" if isinstance(f.dataType, T.StringType) else have[f.name]).try_cast(f.dataType).alias(f.name) for f in schema))
