"""Tables: registration, snapshots, time to live, retention, and what is known about them."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import threading
import time as clock
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import macros
from .errors import TableNotFound
from .functions.timefns import SCALES, time_column
from .operators.access import Rule
from .plans.expressions import sql_of
from .schema import TIME, is_integer, is_metric, is_numeric, parse_schema
from .sources import files, remote
from .spec import ColumnProps, TableSpec, TimeSpec, read_config, table_spec

#: Layout columns of stored snapshots.
DATE = "_date_"
CHUNK = "_chunk_"
#: The stored column that a table's time is computed from, kept beside it where time ranges can bound it.
STORED = "_stored_time_"


@dataclass
class Table:
    """A named frame with the rules and settings that Spark doesn't hold."""

    name: str
    source: DataFrame
    column_props: Mapping[str, ColumnProps] = field(default_factory=dict)
    rules: Sequence[Rule] = ()
    spec: TableSpec | None = None
    time_from: str | None = None

    def frame(self) -> DataFrame:
        """The rows, without layout columns."""
        return self.rows()

    def columns(self) -> list[str]:
        return self.frame().columns

    def rows(self, span: tuple[int, int] | None = None, equals: Mapping[str, Sequence] | None = None) -> DataFrame:
        """The rows of an inclusive range of seconds, as few files as the layout allows. ``equals``: values that columns are known to be
        limited to; those of declared partitions choose the chunks to read, and rows of other values may be left in."""
        df = self.source
        for name, values in (equals or {}).items():
            props = self.column_props.get(name)
            if props and props.partition_values and CHUNK + name in df.columns:
                chunks = {props.partition_values.index(str(v)) // props.partition_chunk for v in values if str(v) in props.partition_values}
                df = df.where(F.col(CHUNK + name).isin(sorted(chunks)) if chunks else F.lit(False))
        if span is not None:
            df = self._within(df, *span)
        hidden = [c for c in df.columns if c in (DATE, STORED) or c.startswith(CHUNK)]
        return df.drop(*hidden) if hidden else df

    def _within(self, df: DataFrame, start: int, end: int) -> DataFrame:
        """The date of the layout is bounded, too, so other days' files aren't opened; or the column that the time comes from, so that row
        groups are skipped by its statistics."""
        rows = df.where(F.col(TIME).between(start, end))
        if DATE in df.columns:
            day = lambda s: F.date_from_unix_date(F.lit(s // 86400))
            rows = rows.where(F.col(DATE).between(day(start), day(end)))
        if STORED in df.columns and start > 1:  # nulls have the time 1, and what can't be read 0
            scale = SCALES[self.spec.time.pattern.upper()]
            rows = rows.where(F.col(STORED).between(start * scale, (end + 1) * scale - 1))
        if self.time_from is not None:
            kind = "timestamp_ntz" if isinstance(df.schema[self.time_from].dataType, T.TimestampNTZType) else "timestamp"
            edge = lambda s: F.timestamp_seconds(F.lit(s)) if kind == "timestamp" else F.expr(f"timestamp_ntz'{dt.datetime.fromtimestamp(s, dt.timezone.utc):%Y-%m-%d %H:%M:%S}'")
            rows = df.where((F.col(self.time_from) >= edge(start)) & (F.col(self.time_from) < edge(end + 1)))
        return rows

    def column_rules(self, name: str) -> Sequence[Rule]:
        """The rules of a column, whose name is the same in any case, as it is to SQL."""
        return tuple(r for n, p in self.column_props.items() if n.lower() == name.lower() for r in p.rules)

    def _histograms(self, df: DataFrame) -> list[tuple[str, Column]]:
        parts = []
        for f in df.schema:
            x, total = F.col(f"`{f.name}`"), F.count(F.lit(1)).alias("count")
            if isinstance(f.dataType, T.BooleanType):
                stats = F.struct(total, F.count_if(x).alias("trues"))
            elif is_numeric(f.dataType):
                wide = "double" if isinstance(f.dataType, T.FloatType | T.DoubleType) else "decimal(38,0)"
                stats = F.struct(total, F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x.cast(wide)).alias("sum"))
            else:
                stats = F.struct(total)
            parts.append((f.name, F.to_json(stats)))
        return parts

    def histograms(self) -> DataFrame:
        """Per column its histogram as JSON: counts; of booleans the true ones; of numbers least, largest, sum. One pass."""
        df = self.frame()
        pairs = [F.struct(F.lit(n).alias("column"), h.alias("histogram")) for n, h in self._histograms(df)]
        return df.agg(F.array(*pairs).alias("all")).select(F.explode("all").alias("h")).select("h.column", "h.histogram")

    def state(self) -> DataFrame:
        """One row: files (blocks; 0 where there are none) and their bytes, rows, first and last time, dimensions, metrics, and each column's histogram. One pass; files
        and bytes come from the listing that the plan already has."""
        df = self.frame()
        dims = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        metrics = [f.name for f in df.schema if is_metric(f.dataType)]
        words = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
        time = F.col(TIME) if TIME in df.columns else F.lit(0)
        leaves, files = self.source._jdf.queryExecution().analyzed().collectLeaves(), len(self.source.inputFiles())
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) if files else 0
        pairs = [F.struct(F.lit(n).alias("column"), h.alias("histogram")) for n, h in self._histograms(df)]
        return df.agg(F.count(F.lit(1)).alias("rows"), F.min(time).cast("long").alias("min_time"), F.max(time).cast("long").alias("max_time"), F.array(*pairs).alias("histograms")).select(
            F.lit(self.name).alias("table"), F.lit(files).cast("long").alias("blocks"), F.lit(size).cast("long").alias("bytes"), "rows", "min_time", "max_time", words(dims).alias("dimensions"), words(metrics).alias("metrics"), "histograms"
        )


def with_time(df: DataFrame, spec: TimeSpec, watermark: int | Column = 0, now: int | None = None, keep: bool = False) -> DataFrame:
    """``_time_`` by a time spec. A source time column leaves the schema; with ``keep`` a stored unix time stays as the hidden column STORED."""
    if spec.type == "STATIC":
        return df.withColumn(TIME, F.lit(spec.value).cast("long"))
    if spec.type == "CURRENT":
        return df.withColumn(TIME, F.lit(int(clock.time()) if now is None else now).cast("long"))
    if spec.type == "MACRO":
        return df.withColumn(TIME, (watermark if isinstance(watermark, Column) else F.lit(watermark)).cast("long"))
    if spec.type == "PROVIDED":
        return df.withColumn(TIME, F.coalesce(F.col(TIME).cast("long"), F.lit(1).cast("long")))
    timed = df.withColumn(TIME, time_column(F.col(f"`{spec.column}`"), spec.pattern))
    if spec.column == TIME:
        return timed
    if keep and spec.pattern.upper() in SCALES and is_integer(df.schema[spec.column].dataType):
        return timed.withColumnRenamed(spec.column, STORED)
    return timed.drop(spec.column)


def with_defaults(df: DataFrame, columns: Mapping[str, ColumnProps]) -> DataFrame:
    """Columns with a default never read null."""
    for f in df.schema:
        props = columns.get(f.name)
        if props and props.default_value not in (None, ""):
            df = df.withColumn(f.name, F.coalesce(f"`{f.name}`", F.lit(props.default_value).cast(f.dataType)))
    return df


def with_chunks(df: DataFrame, columns: Mapping[str, ColumnProps]) -> tuple[DataFrame, list[str]]:
    """A layout column per partition column: the chunk of its value among the declared ones. Other values are refused."""
    made = []
    for name, props in columns.items():
        if not props.partition_values:
            continue
        place = F.array_position(F.array(*map(F.lit, props.partition_values)), F.col(f"`{name}`").cast("string"))
        bad = F.raise_error(F.concat(F.lit(f"value outside the partition of {name}: "), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("null"))))
        df = df.withColumn(CHUNK + name, F.when(place > 0, F.floor((place - 1) / props.partition_chunk).cast("int")).otherwise(bad.cast("int")))
        made.append(CHUNK + name)
    return df, made


class Catalog:
    """The engine's tables, in one session. ``root`` is where snapshots are kept, on any file system."""

    def __init__(self, spark: SparkSession, root: str | None = None, now: Callable[[], float] = clock.time, kafka: Callable[[Mapping[str, str]], DataFrame] | None = None):
        """``kafka`` reads messages by the options of Spark's own batch source, which it replaces in tests."""
        self.spark, self.root, self.now, self.kafka = spark, root.rstrip("/") if root else None, now, kafka
        self._tables: dict[str, Table] = {}
        self._expiry: dict[str, tuple[float, float]] = {}  # seconds to live, and last use
        self._specs: dict[str, TableSpec] = {}
        self._lock = threading.Lock()

    # registration

    def __contains__(self, name: str) -> bool:
        self.expire()
        return name in self._tables

    def list(self, limit: int = 0) -> list[str]:
        self.expire()
        names = sorted(self._tables)
        return names[:limit] if limit else names

    def table(self, name: str) -> Table:
        self.expire()
        if name not in self._tables:
            raise TableNotFound(name)
        return self._tables[name]

    def register(self, name: str, df: DataFrame, time: TimeSpec | None = None, columns: Mapping[str, ColumnProps] | None = None, rules: Sequence[Rule] = (), ttl: float = 0, spec: TableSpec | None = None, time_from: str | None = None) -> Table:
        """Name a frame. ``ttl``: seconds without a query after which it goes; 0 keeps it. ``time_from``: the timestamp column whose whole
        seconds, in UTC, ``_time_`` has; time ranges then also bound that column, which files can be searched by."""
        if time is not None:
            df = with_time(df, time, now=int(self.now()))
        elif TIME not in df.columns:
            df = df.withColumn(TIME, F.lit(0).cast("long"))
        props = dict(columns or {})
        table = Table(name, with_defaults(df, props), props, tuple(rules), spec, time_from)
        with self._lock:
            self._tables[name] = table
            self._expiry.pop(name, None)
            if ttl:
                self._expiry[name] = (ttl, self.now())
        return table

    def hit(self, name: str) -> None:
        """A query renews the table's time to live."""
        with self._lock:
            if name in self._expiry:
                self._expiry[name] = (self._expiry[name][0], self.now())

    def expire(self) -> list[str]:
        """Drop the tables whose time is over."""
        now = self.now()
        with self._lock:
            gone = [n for n, (ttl, used) in self._expiry.items() if used + ttl < now]
            for n in gone:
                self._tables.pop(n, None)
                self._expiry.pop(n, None)
        return gone

    def unload(self, name: str) -> None:
        with self._lock:
            table = self._tables.pop(name, None)
            self._expiry.pop(name, None)
        if table is None:
            raise TableNotFound(name)

    # configs and loading

    def add_yaml(self, text: str) -> list[str]:
        """Define tables at run time; they load on ``load`` or ``refresh``."""
        specs = read_config(text)
        self._specs.update(specs)
        return sorted(specs)

    def add_spec(self, spec: TableSpec) -> None:
        self._specs[spec.name] = spec

    def spec(self, name: str) -> TableSpec:
        if name not in self._specs:
            raise TableNotFound(name)
        return self._specs[name]

    def paths(self, spec: TableSpec, now: int | None = None, values: Mapping[str, Sequence[str]] | None = None) -> list[tuple[str, dict[str, str], int]]:
        """Paths to read, the custom macros' values in each, and its watermark."""
        now = int(self.now()) if now is None else now
        out = []
        for path, chosen in macros.expand(spec.location, {**spec.macros, **(values or {})}):
            kind = macros.granularity(path)
            if kind == "INVALID":
                raise ValueError(f"a time macro lacks its parents in {path!r}")
            if spec.loader.lower() == "roll":
                out += [(p, chosen, mark) for p, mark in macros.roll(path, now, spec.max_seconds)]
            elif kind != "NONE":
                mark = macros.watermark(kind, now)
                out.append((macros.materialize(kind, path, mark), chosen, mark))
            else:
                out.append((path, chosen, now))
        return out

    def read(self, spec: TableSpec, now: int | None = None, values: Mapping[str, Sequence[str]] | None = None, fetch: remote.Fetch | None = None) -> DataFrame:
        """The rows of a spec's location, with ``_time_``, macro columns and defaults.

        Paths with the same macro values are read together, as one scan; watermarks are read from the files' paths, so a time range prunes files.
        """
        schema = parse_schema(spec.schema)
        from_macro = {c: p.from_macro for c, p in spec.columns.items() if p.from_macro}
        computed = {c: p.expr for c, p in spec.columns.items() if p.expr}
        # pruned: columns that macros or expressions fill, and _time_ where the spec makes it, aren't in the files
        stored = T.StructType([f for f in schema if f.name not in from_macro and f.name not in computed and not (f.name == TIME and spec.time.type not in ("PROVIDED", "COLUMN"))])
        if spec.time.type == "COLUMN" and spec.time.column not in stored.names:
            stored = T.StructType([*stored, T.StructField(spec.time.column, T.StringType())])
        if spec.source == "TEST":
            from .sources.synthetic import synthetic

            return synthetic(self.spark, rows=int(spec.settings.get("rows", "10000")))
        now = int(self.now()) if now is None else now
        if spec.source == "KAFKA":
            return with_defaults(self._messages(spec, schema, now), spec.columns)
        remote_source = spec.source in ("HTTP", "GSHEET", "ROCKSET")
        groups: dict[tuple, list[tuple[str, int]]] = {}
        for path, chosen, mark in self.paths(spec, now, values):
            groups.setdefault(tuple(sorted(chosen.items())), []).append((path, mark))
        parts = []
        for chosen, found in groups.items():
            if not remote_source:
                there = self._existing(spec, dict(chosen), [p for p, _ in found])
                found = [(p, m) for p, m in found if p in there]
            if not found:
                continue
            marks = {m for _, m in found}
            if spec.time.type == "MACRO" and len(marks) > 1 and remote_source:
                scans = [([p], m) for p, m in found]
            else:
                scans = [([p for p, _ in found], next(iter(marks)))]
            for paths, mark in scans:
                df = self._scan(spec, paths, stored, fetch)
                if spec.time.type == "MACRO" and len(marks) > 1 and not remote_source:
                    mark = macros.time_of_path(spec.location, F.col("_metadata.file_path"))
                df = with_time(df, spec.time, mark, now, keep=spec.format in ("PARQUET", "NONE") and not remote_source)
                given = {k.lower(): x for k, x in chosen}
                for column, macro in from_macro.items():
                    df = df.withColumn(column, F.lit(given.get(macro.lower(), "")).cast(schema[column].dataType))
                for column, expr in computed.items():
                    df = df.withColumn(column, F.expr(sql_of(expr)).try_cast(schema[column].dataType))
                parts.append(df)
        if not parts:
            raise FileNotFoundError(f"nothing to load for {spec.name!r} at {spec.location!r}")
        out = parts[0]
        for df in parts[1:]:
            out = out.unionByName(df)
        return with_defaults(out, spec.columns)

    def _existing(self, spec: TableSpec, chosen: Mapping[str, str], paths: list[str]) -> set[str]:
        """Those of ``paths`` that are there. Many are found by one listing of the location with its time macros as wildcards."""
        if len(paths) == 1:
            return set(paths) if self._exists(paths[0]) else set()
        pattern = next(p for p, c in macros.expand(spec.location, {k: [x] for k, x in chosen.items()}))
        fs, p = self._fs(macros.wildcards(pattern))
        found = {str(s.getPath().toUri().getPath()) for s in fs.globStatus(p) or []}
        return {x for x in paths if self._fs(x)[1].toUri().getPath() in found}

    def _messages(self, spec: TableSpec, schema: T.StructType, now: int) -> DataFrame:
        """A topic's messages: of one segment, where the settings name a partition and an offset in it, or else all of the retention."""
        from .streaming import append

        map_ = spec.thrift.columns_map if spec.format == "THRIFT" else spec.json.columns_map
        serde = "THRIFT" if spec.format == "THRIFT" else "JSON"
        size = int(spec.settings.get("batch", 0)) or spec.kafka.size or append.SEGMENT
        more = {"serde": serde, "columns_map": map_, "reader": self.kafka}
        if "k.partition" in spec.settings and "k.offset" in spec.settings:
            first = int(spec.settings["k.offset"]) // size * size
            return append.kafka_batches(self.spark, spec.location, spec.kafka.topic, schema, {int(spec.settings["k.partition"]): (first, first + size)}, size=size, **more)
        kept = spec.kafka.retention or spec.max_seconds
        return append.kafka_messages(self.spark, spec.location, spec.kafka.topic, schema, int((now - kept) * 1000) if kept else None, **more)

    def _scan(self, spec: TableSpec, paths: list[str], schema: T.StructType, fetch: remote.Fetch | None) -> DataFrame:
        get = {"fetch": fetch} if fetch else {}
        headers = remote.header_map(spec.headers, spec.settings.get("token", ""))
        if spec.source == "HTTP":
            return remote.http_table(self.spark, paths, spec.format, schema, headers, csv_props=spec.csv, json_props=spec.json, **get)
        if spec.source == "ROCKSET":
            end = int(self.now())
            bodies = remote.slice_bodies(int(end - spec.max_seconds), end, spec.slices.interval)
            return remote.http_table(self.spark, paths * len(bodies), "JSON", schema, {"Authorization": f"ApiKey {spec.slices.api_key}", "Content-Type": "application/json", **headers}, bodies, json_props=replace(spec.json, rows_field=spec.json.rows_field or "results"), **get)
        if spec.source == "GSHEET" or spec.format == "GSHEET":
            return remote.read_sheet(self.spark, spec.settings["id"], int(spec.settings.get("rows", 1000)), int(spec.settings.get("cols", 26)), schema, spec.settings.get("token", ""), **get)
        if spec.format == "CSV":
            return files.read_csv(self.spark, paths, schema, spec.csv)
        if spec.format == "JSON":
            return files.read_json(self.spark, paths, schema, spec.json)
        if spec.format in ("PARQUET", "NONE"):
            return files.read_parquet(self.spark, paths, schema)
        raise ValueError(f"files of format {spec.format} aren't supported")

    def load(self, name: str, ttl: float = 0, fetch: remote.Fetch | None = None) -> Table:
        """Load a defined table, through a snapshot where the catalog has a root."""
        spec = self.spec(name)
        df = self.read(spec, fetch=fetch)
        if self.root:
            self.publish(name, df, spec.columns)
            return self.open(name, ttl)
        return self.register(name, df, None, spec.columns, spec.rules, ttl, spec)

    def load_demand(self, request: Mapping, ttl: float = 3600, fetch: remote.Fetch | None = None) -> str:
        """Load what a request describes (a table's config section), as an ephemeral table; its name."""
        name = "$" + hashlib.md5(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:12]
        if name not in self:
            spec = table_spec(name, request)
            self.register(name, self.read(spec, fetch=fetch), None, spec.columns, spec.rules, ttl, spec)
        self.hit(name)
        return name

    def load_template(self, template: str, values: Mapping[str, Sequence[str] | str], ttl: float = 3600) -> str:
        """Clone a defined table with macros filled in, as an ephemeral table; its name.

        A bucket column among the values picks the one bucket that holds it.
        """
        spec = self.spec(template)
        filled = {k: [x] if isinstance(x, str) else [str(y) for y in x] for k, x in values.items()}
        if spec.bucket and spec.bucket.column in filled and "bucket" not in filled:
            from .functions.codecs import hash_bucket

            keys = self.spark.createDataFrame([(int(x),) for x in filled[spec.bucket.column]], "v long")
            found = sorted({r[0] for r in keys.select(hash_bucket(F.col("v"), spec.bucket.size)).collect()})
            filled["bucket"] = [str(b).zfill(len(str(spec.bucket.size - 1))) for b in found]
        name = f"${template}-" + hashlib.md5(json.dumps(filled, sort_keys=True).encode()).hexdigest()[:12]
        if name not in self:
            self.register(name, self.read(spec, values=filled), None, spec.columns, spec.rules, ttl, spec)
        self.hit(name)
        return name

    # snapshots

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        found = fs.globStatus(p)
        return found is not None and len(found) > 0

    def _manifests(self, name: str) -> list[str]:
        """A table's manifests, the newest last."""
        fs, p = self._fs(f"{self._root()}/{name}")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if re.fullmatch(r"manifest-\d{12}", s.getPath().getName()))

    def _announce(self, name: str, manifest: Mapping) -> None:
        """Make a snapshot the current one: write the next manifest aside and rename it to its number. The former ones stay, so a reader
        finds one at any time, and a crash leaves the last."""
        base, text = f"{self._root()}/{name}", json.dumps(manifest)
        while True:
            number = int((self._manifests(name) or ["manifest-0"])[-1].split("-")[1]) + 1
            fs, target = self._fs(f"{base}/manifest-{number:012d}")
            side = self._fs(f"{base}/.manifest-{uuid.uuid4().hex}")[1]
            out = fs.create(side, False)
            out.write(text.encode())
            out.close()
            if not fs.exists(target) and fs.rename(side, target):
                return
            fs.delete(side, False)  # another writer took the number

    def manifest(self, name: str) -> dict | None:
        """What the newest manifest says: ``version``, and ``oldest``, the first second that is kept."""
        found = self._manifests(name)
        if not found:
            return None
        row = self.spark.read.text(f"{self._root()}/{name}/{found[-1]}", wholetext=True).first()
        return json.loads(row[0])

    def publish(self, name: str, df: DataFrame, columns: Mapping[str, ColumnProps] | None = None) -> str:
        """Write a snapshot, laid out by date and declared partitions, and make it the current one; its version.

        Readers of the former snapshot keep their files; ``vacuum`` removes old ones.
        """
        base = f"{self._root()}/{name}"
        version = f"{int(self.now())}_{clock.time_ns() % 10**9:09d}"
        laid, chunks = with_chunks(df.drop(STORED), columns or {})
        laid = laid.withColumn(DATE, F.date_from_unix_date(F.floor(F.col(TIME) / 86400).cast("int")))
        # rows of a day go together, and large days are split by size
        writer = laid.hint("rebalance", DATE, *chunks).write
        for c, p in (columns or {}).items():
            if p.bloom_filter:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
            if p.dict:
                writer = writer.option(f"parquet.enable.dictionary#{c}", "true")
        writer.partitionBy(DATE, *chunks).parquet(f"{base}/{version}")
        self._announce(name, {"version": version})
        return version

    def _root(self) -> str:
        if not self.root:
            raise ValueError("the catalog has no root for snapshots")
        return self.root

    def current(self, name: str) -> str | None:
        found = self.manifest(name)
        return found["version"] if found else None

    def open(self, name: str, ttl: float = 0) -> Table:
        """Register a table's current snapshot."""
        found = self.manifest(name)
        if found is None:
            raise TableNotFound(name)
        spec = self._specs.get(name)
        df = self.spark.read.parquet(f"{self._root()}/{name}/{found['version']}")
        if (oldest := found.get("oldest")) is not None:
            df = df.where((F.col(TIME) >= oldest) & (F.col(DATE) >= F.date_from_unix_date(F.lit(oldest // 86400))))
        known = self._tables.get(name)
        return self.register(name, df, None, spec.columns if spec else known.column_props if known else None, spec.rules if spec else known.rules if known else (), ttl, spec)

    def retain(self, name: str, max_seconds: float) -> str:
        """Give up rows older than ``max_seconds``: a manifest says so, and ``vacuum`` removes the days that ended before. No row is
        rewritten, and later ones stay whatever their time. Returns the version, which stays the same."""
        found = self.manifest(name)
        if found is None:
            raise TableNotFound(name)
        oldest = max(int(self.now() - max_seconds), found.get("oldest", -(1 << 62)))
        self._announce(name, {**found, "oldest": oldest})
        self.open(name)
        return found["version"]

    def vacuum(self, name: str, keep: int = 2) -> list[str]:
        """Remove all but the newest ``keep`` snapshots and the current one, all but the newest manifest, and the current snapshot's days
        that ended before what is kept; which snapshots went."""
        base, now = f"{self._root()}/{name}", self.manifest(name) or {}
        fs, p = self._fs(base)
        found = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        gone = [v for v in found[: max(0, len(found) - keep)] if v != now.get("version")]
        for v in gone:
            fs.delete(self._fs(f"{base}/{v}")[1], True)
        for m in self._manifests(name)[:-1]:
            fs.delete(self._fs(f"{base}/{m}")[1], False)
        if "oldest" in now:
            drop_days(self, f"{base}/{now['version']}", now["oldest"])
        return gone


def drop_days(catalog: Catalog, pattern: str, oldest: int) -> int:
    """Remove the days under a path (which may have wildcards) that ended before a second; how many directories went."""
    fs, p = catalog._fs(f"{pattern}/{DATE}=*")
    gone = 0
    for status in fs.globStatus(p) or []:
        day = dt.date.fromisoformat(status.getPath().getName().split("=")[1])
        if (day - dt.date(1970, 1, 1)).days < oldest // 86400:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
