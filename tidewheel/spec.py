"""Table specs, as configs and load requests define them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from .operators.access import Rule, read_rules

# The names that configs use.
SOURCES = ("LOCAL", "S3", "GS", "ABFS", "KAFKA", "HTTP", "GSHEET", "ROCKSET", "TEST")
FORMATS = ("NONE", "CSV", "JSON", "THRIFT", "PARQUET", "GSHEET")
LOADERS = ("Swap", "Roll", "Api", "Template", "Streaming", "Test")
TIME_TYPES = ("STATIC", "CURRENT", "COLUMN", "MACRO", "PROVIDED")
#: Minutes that a sliced source's interval may have.
SLICE_MINUTES = (1, 2, 5, 10, 15, 20, 30)


@dataclass(frozen=True)
class CsvProps:
    has_header: bool = True
    has_meta: bool = False
    delimiter: str = ","
    compression: str = ""


@dataclass(frozen=True)
class JsonProps:
    rows_field: str = ""
    columns_map: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ThriftProps:
    protocol: str = "binary"
    columns_map: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class KafkaProps:
    topic: str = ""
    retention: int = 0
    size: int = 0


@dataclass(frozen=True)
class SliceProps:
    api_key: str = ""
    interval: int = 60  # seconds


@dataclass(frozen=True)
class TimeSpec:
    type: str = "CURRENT"
    value: int = 0
    column: str = ""
    pattern: str = ""


@dataclass(frozen=True)
class ColumnProps:
    bloom_filter: bool = False
    dict: bool = False
    default_value: str | None = None
    from_macro: str = ""
    expr: str = ""  # computed when the table is loaded
    rules: tuple[Rule, ...] = ()
    partition_values: tuple[str, ...] = ()
    partition_chunk: int = 1


@dataclass(frozen=True)
class Bucket:
    size: int
    column: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: str
    source: str = "LOCAL"
    loader: str = "Swap"
    location: str = ""
    format: str = "PARQUET"
    max_mb: int = 0
    max_seconds: float = 0
    time: TimeSpec = field(default_factory=TimeSpec)
    csv: CsvProps = field(default_factory=CsvProps)
    json: JsonProps = field(default_factory=JsonProps)
    thrift: ThriftProps = field(default_factory=ThriftProps)
    kafka: KafkaProps = field(default_factory=KafkaProps)
    slices: SliceProps = field(default_factory=SliceProps)
    columns: Mapping[str, ColumnProps] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    bucket: Bucket | None = None
    settings: Mapping[str, str] = field(default_factory=dict)
    macros: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    headers: tuple[str, ...] = ()


def snap_minutes(minutes: int) -> int:
    """The least allowed interval that is long enough; 30 at most, 1 at least."""
    return next((m for m in SLICE_MINUTES if m >= max(1, minutes)), SLICE_MINUTES[-1])


def _one_of(value, allowed: tuple[str, ...], what: str) -> str:
    found = next((a for a in allowed if a.lower() == str(value).lower()), None)
    if found is None:
        raise ValueError(f"{what} {value!r} isn't one of {allowed}")
    return found


def read_time(node: Mapping | None) -> TimeSpec:
    node = node or {"type": "CURRENT"}
    kind = _one_of(node.get("type"), TIME_TYPES, "time type")
    if kind == "STATIC":
        return TimeSpec(kind, value=int(node["value"]))
    if kind == "COLUMN":
        return TimeSpec(kind, column=str(node["column"]), pattern=str(node["pattern"]))
    return TimeSpec(kind, pattern=str(node.get("pattern", "")))


def read_columns(node: Mapping | None) -> dict[str, ColumnProps]:
    out = {}
    for name, c in (node or {}).items():
        part = c.get("partition")
        if part is not None and "values" not in part:
            raise ValueError(f"the partition of {name!r} has no values")
        out[str(name)] = ColumnProps(
            bool(c.get("bloom_filter", False)), bool(c.get("dict", False)),
            None if c.get("default_value") is None else str(c["default_value"]), str(c.get("from_macro", "")), str(c.get("expr", "")), read_rules(c.get("access")),
            tuple(map(str, part["values"])) if part else (), int(part.get("chunk", 1)) if part else 1,
        )
    return out


def table_spec(name: str, node: Mapping) -> TableSpec:
    """A spec of one table's config section."""
    source = _one_of(node.get("data", "local"), SOURCES, "data source")
    retention = node.get("retention") or {}
    kafka, slices, csv, json, thrift = (node.get(k) or {} for k in ("kafka", "rockset", "csv", "json", "thrift"))
    if source == "KAFKA" and not kafka.get("topic"):
        raise ValueError(f"table {name!r} has no topic")
    if source == "ROCKSET" and not slices.get("apiKey"):
        raise ValueError(f"table {name!r} has no api key")
    bucket = node.get("bucket")
    base = CsvProps()
    return TableSpec(
        name=name,
        schema=str(node["schema"]),
        source=source,
        loader=_one_of(node.get("loader", "Swap"), LOADERS, "loader"),
        location=str(node.get("source", "")),
        format=_one_of(node.get("format", "none"), FORMATS, "format"),
        max_mb=int(retention.get("max-mb", 0)),
        max_seconds=float(retention.get("max-hr", 0)) * 3600,
        time=read_time(node.get("time")),
        csv=CsvProps(bool(csv.get("hasHeader", base.has_header)), bool(csv.get("hasMeta", base.has_meta)), str(csv.get("delimiter", base.delimiter)), str(csv.get("compression", ""))),
        json=JsonProps(str(json.get("rowsField", "")), {str(k): str(x) for k, x in (json.get("columnsMap") or {}).items()}),
        thrift=ThriftProps(str(thrift.get("protocol", "binary")), {str(k): int(x) for k, x in (thrift.get("columnsMap") or {}).items()}),
        kafka=KafkaProps(str(kafka.get("topic", "")), int(kafka.get("topic-retention", 0)), int(kafka.get("size", 0))),
        slices=SliceProps(str(slices.get("apiKey", "")), 60 * snap_minutes(int(slices.get("interval", 0)))),
        columns=read_columns(node.get("columns")),
        rules=read_rules(node.get("access")),
        bucket=Bucket(int(bucket["size"]), str(bucket["column"])) if bucket else None,
        settings={str(k): str(x) for k, x in (node.get("settings") or {}).items()},
        macros={str(k): tuple(map(str, x)) for k, x in (node.get("macros") or {}).items() if isinstance(x, list)},
        headers=tuple(map(str, node.get("headers") or ())),
    )


def read_config(text: str) -> dict[str, TableSpec]:
    """The tables of a YAML config. A table that can't be read raises; nothing is skipped silently."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configs need PyYAML; table_spec() takes plain dicts") from e
    doc = yaml.safe_load(text) or {}
    return {str(n): table_spec(str(n), c) for n, c in (doc.get("tables") or {}).items()}
