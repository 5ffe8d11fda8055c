"""Reading replication logs into DataFrames.

``read_logs`` takes files from any store that Spark reads; ``decode_logs`` takes a column of log bytes; both decode on
executors, a file (or value) at a time, in order; ``decode_pieces`` takes logs in pieces that are cut anywhere.
``BinlogSource`` is the same as a Python data source, ``spark.read`` and ``spark.readStream`` with the format "tidelog", for
folders that the executors mount; it cuts long files into ranges of splitBytes, which are mapped and read on their own.

A log is told by its path below what is read, with / between folders, so that files of one name in two folders are two logs.
A log whose framing breaks ends with a row CORRUPT of type -1, whose error says where and why (strict: it fails).

Options of the source: path (a file, a folder or a pattern), mode (PERMISSIVE: problems in the error column, FAILFAST),
startingPosition (earliest, latest, file:position), endingPosition (latest, file:position), decodeRows (false: row events as
raw bytes), types (event codes, comma-separated), splitBytes (a batch read's range of a file). Filters on event_type and file are
pushed into the reader.
"""

from __future__ import annotations

import glob
import mmap
import os
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelog.sources import wire
from tidelog.sources.decoders import Decoders
from tidelog.sources.wire import DELETES, EVENT_SCHEMA, UPDATES, WRITES

BATCH_EVENTS = 2000
SPLIT_BYTES = 128 << 20
#: Columns that only payloads tell of.
_OF_PAYLOADS = frozenset(("table_id", "database_name", "table_name", "body", "rows", "error"))
#: What changes() needs of events: for the types and columns of readers.
CHANGED = {"types": set(wire.ROWS), "columns": ("file", "pos", "gtid", "when", "event_type", "database_name", "table_name", "rows")}


def _columns(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[f.name] and e[f.name] * 1_000_000 if f.name == "when" else e[f.name] for e in found], f.type) for f in schema], schema=schema)


def batches(found: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for e in found:
        held.append(e)
        if len(held) >= BATCH_EVENTS:
            yield _columns(held, schema)
            held = []
    if held:
        yield _columns(held, schema)


def _kind(columns: tuple[str, ...] | None) -> StructType:
    kind = StructType.fromDDL(EVENT_SCHEMA)
    return kind if columns is None else StructType([kind[c] for c in columns])


def _state(decoders: Decoders | None) -> wire.State:
    return wire.State(cells=decoders.chosen("cells"), events=decoders.chosen("events")) if decoders else wire.State()


def _decode(parts: Iterator[pa.RecordBatch], schema: pa.Schema, types: set[int] | None, decode_rows: bool, strict: bool, decoders: Decoders | None) -> Iterator[pa.RecordBatch]:
    headers = not _OF_PAYLOADS.intersection(schema.names)

    def found() -> Iterator[dict]:
        for part in parts:
            for name, data in zip(part.column("file"), part.column("data"), strict=True):  # one log at a time is copied
                if data.is_valid:
                    yield from wire.events(data.as_py(), name.as_py(), types=types, decode_rows=decode_rows, state=_state(decoders), strict=strict, headers=headers)

    yield from batches(found(), schema)


def decode_logs(
    logs: DataFrame, data: str, file: str | Column | None = None, types: set[int] | None = None, decode_rows: bool = True, strict: bool = False, decoders: Decoders | None = None,
    columns: tuple[str, ...] | None = None,
) -> DataFrame:
    """Events of a column of log bytes. A null is no log. columns: those that are made; without any of payloads, headers are enough."""
    name = F.lit(None).cast("string") if file is None else F.col(file) if isinstance(file, str) else file
    kind = _kind(columns)
    run = partial(_decode, schema=to_arrow_schema(kind), types=types, decode_rows=decode_rows, strict=strict, decoders=decoders)
    return logs.select(name.alias("file"), F.col(data).cast("binary").alias("data")).mapInArrow(run, kind)


def _pieces(batches_: Iterator[pa.RecordBatch], schema: pa.Schema, types: set[int] | None, decode_rows: bool) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by (file, nr): the events of each file. What a piece ends with is kept until its event is whole."""

    def complete(data: bytes, base: int, begin: int, file: str | None, state: wire.State) -> Iterator[dict]:
        """The complete events of data; returns where they end."""
        end = begin
        try:
            for place, size, code in wire.frames(data, begin):
                end = place + size
                if types is None or code in types:
                    found = wire.event(data, place, size, state, file, decode_rows)
                    found.pop("inner", None)
                    yield found | {"pos": base + place}
                elif code in wire.STATEFUL or code in wire.ROWS:
                    wire.learn(data, place, size, state)
        except ValueError as problem:
            yield wire.corrupt(data, end, file, str(problem)) | {"pos": base + end}
            return len(data)
        return end

    def events() -> Iterator[dict]:
        now, held, size, needed, base, state, seen = None, [], 0, 4, 0, wire.State(), False
        for batch in batches_:
            for file, piece in zip(batch.column("file"), batch.column("data"), strict=True):
                file, piece = file.as_py(), piece.as_py() or b""
                if file != now:
                    now, held, size, needed, base, state, seen = file, [], 0, 4, 0, wire.State(), False
                held.append(piece)
                size += len(piece)
                if size < needed:
                    continue
                data = b"".join(held)
                end = yield from complete(data, base, 4 if not seen and data[:4] == wire.MAGIC else 0, now, state)
                seen, base, left = True, base + end, data[end:]
                held, size = [left], len(left)
                needed = int.from_bytes(left[9:13], "little") if size >= wire.HEADER else wire.HEADER

    yield from batches(events(), schema)


def decode_pieces(pieces: DataFrame, file: str, order: str, data: str, types: set[int] | None = None, decode_rows: bool = True, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Events of logs that come in pieces, cut anywhere: an event that a piece begins ends in a later one, and table maps hold on."""
    kind = _kind(columns)
    rows = pieces.select(F.col(file).alias("file"), F.col(order).alias("nr"), F.col(data).cast("binary").alias("data")).repartition("file").sortWithinPartitions("file", "nr")
    return rows.mapInArrow(partial(_pieces, schema=to_arrow_schema(kind), types=types, decode_rows=decode_rows), kind)


def _below(path: str) -> Column:
    """The path column's part below what is read; a single file's own name."""
    root = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    root = root.rstrip("/") if root == path else root.rpartition("/")[0]
    root = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", root, flags=re.I) or "/"
    at = F.locate(root.rstrip("/") + "/", F.col("path"))
    rest = F.substring(F.col("path"), at + len(root.rstrip("/")) + 1, 1 << 30)
    return F.when((at > 0) & (rest != ""), rest).otherwise(F.element_at(F.split("path", "/"), -1))


def read_logs(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events of every file under a path (a file, folder or pattern of any store). A file is held whole by its task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decode_logs(files.select(_below(path).alias("file"), F.col("content").alias("data")), "data", "file", **options)


def stream_logs(spark: SparkSession, path: str, files_per_trigger: int = 100, **options) -> DataFrame:
    """Events of finished log files as they appear in a folder of any store, so many files a batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return decode_logs(files.select(_below(path).alias("file"), F.col("content").alias("data")), "data", "file", **options)


def changes(events: DataFrame) -> DataFrame:
    """(file, pos, row_no, gtid, when, op, database_name, table_name, before, after): one row a changed row."""
    op = F.when(F.col("event_type").isin(*WRITES), "INSERT").when(F.col("event_type").isin(*UPDATES), "UPDATE").when(F.col("event_type").isin(*DELETES), "DELETE")
    rows = events.where(F.col("event_type").isin(*WRITES, *UPDATES, *DELETES)).withColumn("op", op)
    return rows.select("file", "pos", F.posexplode("rows").alias("row_no", "r"), "gtid", "when", "op", "database_name", "table_name").select("file", "pos", "row_no", "gtid", "when", "op", "database_name", "table_name", "r.before", "r.after")


def table_maps(events: DataFrame) -> DataFrame:
    """(file, pos, table_id, database_name, table_name, columns) of table map events."""
    kind = "struct<flags:int,columns:array<struct<ordinal:int,name:string,type:string,meta:int,nullable:boolean,unsigned:boolean,primary_key:boolean,labels:array<string>,charset:int,geometry:int,visible:boolean>>>"
    maps = events.where("event_type = 19").withColumn("b", F.from_json("body", kind))
    return maps.select("file", "pos", "table_id", "database_name", "table_name", "b.columns")


def typed(feed: DataFrame, columns: list[tuple[str, str]], image: str = "after", keep: tuple[str, ...] = ("file", "pos", "op")) -> DataFrame:
    """An image's cells as columns of their types; what doesn't fit a type is null."""
    return feed.select(*(c for c in keep if c in feed.columns), *(F.get(image, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns)))


def is_from(position: str) -> Column:
    """Whether an event begins at a place, file:position, or after it (files are ordered by their names)."""
    file, _, pos = position.rpartition(":")
    return (F.col("file") > file) | ((F.col("file") == file) & (F.col("pos") >= int(pos)))


def is_until(position: str) -> Column:
    """Whether an event begins before a place, file:position."""
    file, _, pos = position.rpartition(":")
    return (F.col("file") < file) | ((F.col("file") == file) & (F.col("pos") < int(pos)))


def from_position(events: DataFrame, position: str) -> DataFrame:
    """Events from a start on: earliest, or file:position."""
    return events if position == "earliest" else events.where(is_from(position))


def end_positions(events: DataFrame) -> DataFrame:
    """(file, end): where each log's complete events end."""
    return events.groupBy("file").agg(F.max(F.col("pos") + F.col("event_length")).alias("end"))


def end_position(events: DataFrame) -> str | None:
    """``file:position`` after the last event of the last log: where reading from the end begins."""
    last = events.agg(F.max(F.struct("file", F.col("pos") + F.col("event_length"))).alias("last")).first().last
    return None if last is None else f"{last[0]}:{last[1]}"


def until_position(events: DataFrame, position: str) -> DataFrame:
    """Events that begin before an end, file:position."""
    return events.where(is_until(position))


def from_gtid(events: DataFrame, executed: DataFrame) -> DataFrame:
    """Events whose transaction isn't in a set (source, start, end); events without a transaction stay."""
    from tidelog.operators.gtid import contains

    keyed = events.withColumn("_gtid_source", F.substring_index("gtid", ":", 1)).withColumn("_gtid_number", F.substring_index("gtid", ":", -1).try_cast("bigint"))
    return contains(keyed, executed, "_gtid_source", "_gtid_number", covered=False).drop("_gtid_source", "_gtid_number")


class _File(InputPartition):
    def __init__(self, path: str, name: str, start: int = 0, end: int | None = None):
        super().__init__((path, name, start, end))
        self.path, self.name, self.start, self.end = path, name, start, end


def log_files(path: str) -> dict[str, str]:
    """Path of each log by its name, in the order of names."""
    found = glob.glob(os.path.join(path, "**"), recursive=True) if os.path.isdir(path) else glob.glob(path)
    fixed = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    root = path if os.path.isdir(path) else os.path.dirname(fixed)
    logs = {os.path.relpath(p, root or ".").replace(os.sep, "/"): p for p in found if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_"))}
    return dict(sorted(logs.items()))


class _Options:
    def __init__(self, options: dict, schema: StructType):
        self.arrow = to_arrow_schema(schema)
        options = {k.lower(): v for k, v in options.items()}
        if not options.get("path"):
            raise ValueError("the option path is missing")
        self.path, self.strict = options["path"], options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.decode_rows = options.get("decoderows", "true").lower() != "false"
        self.types = {int(x) for x in options["types"].split(",")} if options.get("types") else None
        self.start, self.stop = options.get("startingposition", "earliest"), options.get("endingposition", "latest")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def read(self, part: _File, types: set[int] | None) -> Iterator[pa.RecordBatch]:
        if not os.path.getsize(part.path):
            return
        with open(part.path, "rb") as file, mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield from batches(wire.events(data, part.name, part.start, types, self.decode_rows, strict=self.strict, end=part.end), self.arrow)


class BinlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BinlogReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return BinlogStream(dict(self.options), schema)


class BinlogReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.types, self.files = _Options(options, schema), None, None
        self.types = self.options.types

    def pushFilters(self, filters):
        """Filters on event_type and file are used here, and left with Spark as well."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("event_type",):
                self.types = set(values) if self.types is None else self.types & set(values)
            elif values is not None and f.attribute == ("file",):
                self.files = set(values)
            yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of files; nothing of them is read here. A range takes the events that begin in it."""
        file, _, position = self.options.start.rpartition(":")
        last, _, stop = self.options.stop.rpartition(":")
        parts = []
        if self.options.start == "latest":
            return [_File("", "")]
        for name, path in log_files(self.options.path).items():
            if (self.files is None or name in self.files) and name >= file and (not last or name <= last):
                low, size = int(position) if file and name == file else 0, os.path.getsize(path)
                end = min(size, int(stop)) if last and name == last else size
                cuts = [low, *range(low - low % self.options.split + self.options.split, end, self.options.split), end]
                parts += [_File(path, name, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
        return parts or [_File("", "")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from self.options.read(partition, self.types)


class BinlogStream(DataSourceStreamReader):
    """A folder of logs that grow. An offset has the end of what was read of each file; an event that is still being written
    is not complete, so it stays for a later batch."""

    def __init__(self, options: dict, schema: StructType):
        self.options = _Options(options, schema)
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        start = self.options.start
        if start == "latest":
            return {name: self._end(p, 0) for name, p in log_files(self.options.path).items()}
        file, _, position = start.rpartition(":")
        if not file:
            return {}
        return {name: (int(position) if name == file else os.path.getsize(p)) for name, p in log_files(self.options.path).items() if name <= file}

    def _end(self, path: str, start: int) -> int:
        """The end of complete events from a place on, by their headers alone."""
        with open(path, "rb") as file:
            size = os.path.getsize(path)
            at = start or (4 if file.read(4) == wire.MAGIC else 0)
            while at + wire.HEADER <= size:
                file.seek(at)
                own = int.from_bytes(file.read(wire.HEADER)[9:13], "little")
                if own < wire.HEADER or at + own > size:
                    break
                at += own
        return at

    def latestOffset(self) -> dict:
        """All that is complete. (A reader isn't told where its query stands, so it can't hand out less and stay in order;
        stream_logs limits a batch by its number of files.)"""
        self.ends = {name: self._end(p, self.ends.get(name, 0)) for name, p in log_files(self.options.path).items()}
        return self.ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        paths = log_files(self.options.path)
        return [_File(paths[n], n, start.get(n, 0), e) for n, e in end.items() if n in paths and e > start.get(n, 0)]

    def commit(self, end: dict) -> None: ...

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        yield from self.options.read(partition, self.options.types)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and turns on the pushing of filters into Python sources, which it needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinlogSource)


def event_function(spark: SparkSession, name: str = "binlog_events") -> None:
    """Registers a table function: the events (code, name, position, length, gtid) of the bytes of a log."""

    @F.udtf(returnType="event_type int, event_name string, pos long, event_length long, gtid string")
    class Events:
        def eval(self, data: bytes):
            for e in wire.events(bytes(data or b""), headers=True):
                yield e["event_type"], e["event_name"], e["pos"], e["event_length"], e["gtid"]

    spark.udtf.register(name, Events)
