"""Sources behind HTTP: files, sheets, and services that answer for slices of time."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..spec import CsvProps, JsonProps
from .vectors import read_vectors

#: Gets bytes: (url, headers, body or None).
Fetch = Callable[[str, Mapping[str, str], bytes | None], bytes]


def download(url: str, headers: Mapping[str, str], body: bytes | None = None) -> bytes:
    request = urllib.request.Request(url, data=body, headers=dict(headers))
    with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310
        return answer.read()


def header_map(lines: Sequence[str], token: str = "") -> dict[str, str]:
    """``name: value`` lines, and a bearer token."""
    out = {n.strip(): x.strip() for n, _, x in (line.partition(":") for line in lines) if n.strip()}
    if token:
        out["Authorization"] = f"Bearer {token}"
    return out


def _rows(payload: bytes, kind: str, schema: T.StructType, csv_props: CsvProps, json_props: JsonProps) -> list[dict]:
    import csv as csv_module
    import io

    from .convert import headers

    if kind == "CSV":
        lines = list(csv_module.reader(io.StringIO(payload.decode("utf-8-sig")), delimiter=csv_props.delimiter))
        names = headers(lines[0]) if csv_props.has_header and lines else schema.names
        rest = lines[csv_props.has_header + csv_props.has_meta :]
        return [dict(zip(names, r, strict=False)) for r in rest if len(r) >= len(names)]
    if kind == "JSON":
        text = payload.decode("utf-8")
        if not json_props.rows_field:
            return [json.loads(x) for x in text.splitlines() if x.strip()]
        doc = json.loads(text)
        for part in [] if json_props.rows_field == "[ROOT]" else json_props.rows_field.split("."):
            doc = doc[part]
        return doc
    raise ValueError(f"format {kind!r} over HTTP")


def _converted(value, kind):
    """A value of one Arrow type in another; null where it can't be converted."""
    import math

    import pyarrow as pa

    try:
        if pa.types.is_string(kind) and isinstance(value, float):
            return str(value)
        if pa.types.is_integer(kind) and isinstance(value, float):
            value = math.trunc(value)
        return pa.scalar(value).cast(kind).as_py()
    except (pa.ArrowException, ValueError, OverflowError):
        return None


def _parquet(payload: bytes, arrow) -> Iterator:
    """Batches of a Parquet file's declared columns, as read_parquet has them: all must be there, and what can't be converted is null."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    file = pq.ParquetFile(pa.BufferReader(payload))
    missing = [f.name for f in arrow if f.name not in file.schema_arrow.names]
    if missing:
        raise ValueError(f"the file has no column {missing[0]!r}")
    wanted = None if any("." in f.name for f in arrow) else arrow.names  # with columns=, a dot is a path
    for batch in file.iter_batches(10_000, columns=wanted):
        cells = [batch.column(batch.schema.get_field_index(f.name)) for f in arrow]
        yield pa.RecordBatch.from_arrays([c if c.type == f.type else pa.array([_converted(x, f.type) for x in c.to_pylist()], f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)


def http_table(spark: SparkSession, urls: Sequence[str], kind: str, schema: T.StructType, headers: Mapping[str, str] | None = None, bodies: Sequence[bytes | None] | None = None, csv_props: CsvProps = CsvProps(), json_props: JsonProps = JsonProps(), fetch: Fetch = download) -> DataFrame:  # noqa: B008
    """A frame of what the URLs answer, CSV, JSON or Parquet; each URL is fetched by a task, and its rows stay there.

    ``fetch`` is shipped to the tasks; tests inject one.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..schema import zero
    from .vectors import _value

    asked = [(u, (bodies[i] if bodies else None)) for i, u in enumerate(urls)]
    todo = spark.createDataFrame(asked, "url string, body binary").repartition(max(1, len(asked)))
    lower = {k.lower(): x for k, x in json_props.columns_map.items()}
    arrow, sent = to_arrow_schema(schema), dict(headers or {})

    def pick(row: Mapping, name: str):
        value = row
        for part in lower.get(name.lower(), name).split(".") if lower.get(name.lower(), name) not in row else [lower.get(name.lower(), name)]:
            value = value.get(part) if isinstance(value, Mapping) else None
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = fetch(url, sent, body)
                if kind == "PARQUET":
                    yield from _parquet(payload, arrow)
                    continue
                rows = _rows(payload, kind, schema, csv_props, json_props)
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([_value(pick(r, f.name), f.dataType) if zero(f.dataType) is not None else pick(r, f.name) for r in part], a.type) for f, a in zip(schema, arrow, strict=True)], schema=arrow)

    return todo.mapInArrow(run, schema)


def slices(start: int, end: int, interval: int) -> list[tuple[int, int]]:
    """Aligned slices [from, to) of a range of seconds."""
    first = start - start % interval
    return [(a, a + interval) for a in range(first, end, interval)]


def slice_bodies(start: int, end: int, interval: int, from_name: str = "start", to_name: str = "end") -> list[bytes]:
    """A POST body with its parameters for each slice."""
    return [json.dumps({"parameters": [{"name": from_name, "type": "int", "value": str(a)}, {"name": to_name, "type": "int", "value": str(b)}]}).encode() for a, b in slices(start, end, interval)]


def sheet_url(sheet: str, rows: int, columns: int, tab: str = "Sheet1") -> str:
    letters, n = "", columns
    while n:
        n, r = divmod(n - 1, 26)
        letters = chr(65 + r) + letters
    return f"https://sheets.googleapis.com/v4/spreadsheets/{quote(sheet)}/values/{quote(f'{tab}!A1:{letters}{rows}')}?majorDimension=COLUMNS"


def read_sheet(spark: SparkSession, sheet: str, rows: int, columns: int, schema: T.StructType | None = None, token: str = "", fetch: Fetch = download) -> DataFrame:
    """A sheet of at most rows x columns cells, through the driver."""
    doc = json.loads(fetch(sheet_url(sheet, rows, columns), header_map((), token), None))
    return read_vectors(spark, doc.get("values", []), schema)
