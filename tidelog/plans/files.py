"""Queries of logs and relay storage as files, in pieces, broken, and with handlers and decoders of one's own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tidelog.operators import catalog, relay
from tidelog.plans.registry import query, read
from tidelog.plans.relays import records
from tidelog.plans.sources import CHUNK, logs
from tidelog.plans.streams import stream
from tidelog.sources import binlog, scratch
from tidelog.sources.decoders import Decoders
from tidelog.streaming.changes import CountingHandler, RowHandler, handled

PIECE = 997
_OP = "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"


def _write_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    made: set[str] = set()
    for batch in batches:
        for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
            path = f"{root}/{name}"
            if (parent := path.rpartition("/")[0]) not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(path, compression=None) as file:
                file.write(data)
        yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])


@query(f"SELECT (event_id // {CHUNK}) % 2 AS folder, {_OP} AS op, count(*) AS rows, count(DISTINCT event_id // {CHUNK}) AS files FROM events GROUP BY 1, 2")
def log_files_scan(spark, sf_dir):
    """Logs as files in two folders, in which the same names occur."""
    folder = scratch.folder(spark, "logs")
    nr = F.substring_index("file", ".", -1).cast("long")
    named = logs(spark, sf_dir).select(F.concat((nr % 2).cast("string"), F.lit("/log."), F.floor(nr / 2).cast("string")).alias("name"), "data")
    named.mapInArrow(lambda batches: _write_files(batches, folder), "name string").count()
    feed = binlog.changes(binlog.read_logs(spark, folder, **binlog.CHANGED))
    return feed.groupBy(F.substring_index("file", "/", 1).cast("long").alias("folder"), "op").agg(F.count("*").alias("rows"), F.count_distinct("file").alias("files"))


@query(f"SELECT event_id // {CHUNK} AS log, {_OP} AS op, count(*) AS rows, '80549ecc-d2f2-11ea-b790-0242ac130002:' || (max(event_id) + 1) AS last_gtid FROM events GROUP BY 1, 2")
def log_pieces(spark, sf_dir):
    """Logs cut into pieces at any byte; table maps and transactions hold on from piece to piece."""
    whole = logs(spark, sf_dir).withColumn("n", F.ceil(F.octet_length("data") / PIECE).cast("int"))
    pieces = whole.select("file", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nr"), "data").select("file", "nr", F.expr(f"substring(data, nr * {PIECE} + 1, {PIECE})").alias("data"))
    feed = binlog.changes(binlog.decode_pieces(pieces, "file", "nr", "data", **binlog.CHANGED))
    number = F.substring_index("gtid", ":", -1).cast("long")
    return feed.groupBy(F.substring_index("file", ".", -1).cast("long").alias("log"), "op").agg(F.count("*").alias("rows"), F.max_by("gtid", number).alias("last_gtid"))


@query(f"""WITH n AS (SELECT count(DISTINCT event_id // {CHUNK}) AS logs FROM events) SELECT 'CORRUPT' AS event_name, logs AS events, 'an event of 3 bytes' AS error FROM n UNION ALL SELECT 'FORMAT_DESCRIPTION', logs, NULL FROM n""")
def corrupt_logs(spark, sf_dir):
    """Each log's second event tells a length that can't be: what follows is one row."""
    first = F.expr("conv(hex(substring(data, 17, 1)) || hex(substring(data, 16, 1)) || hex(substring(data, 15, 1)) || hex(substring(data, 14, 1)), 16, 10)").cast("int")
    broken = logs(spark, sf_dir).withColumn("at", first + 4).select("file", F.expr("substring(data, 1, at + 9) || X'03000000' || substring(data, at + 14)").alias("data"))
    found = binlog.decode_logs(broken, "data", "file", columns=("event_name", "error"))
    return found.groupBy("event_name", F.substring_index("error", " at ", 1).alias("error")).agg(F.count("*").alias("events"))


@query(f"SELECT 'log.' || lpad((max(event_id) // {CHUNK})::VARCHAR, 6, '0') AS file, (5 * count(*) + count(DISTINCT event_id // {CHUNK}))::BIGINT AS before, 0::BIGINT AS after FROM events")
def end_of_log(spark, sf_dir):
    """Where the last log ends, and how many events lie before and after that place."""
    events = binlog.decode_logs(logs(spark, sf_dir), "data", "file", columns=("file", "pos", "event_length"))
    end = binlog.end_position(events)
    return events.agg(F.lit(end.rpartition(":")[0]).alias("file"), F.count_if(binlog.is_until(end)).alias("before"), F.count_if(binlog.is_from(end)).alias("after"))


@query(f"""WITH n AS (SELECT count(*) AS n, count(DISTINCT event_id // {CHUNK}) AS logs FROM events)
SELECT name AS event_name, CASE name WHEN 'FORMAT_DESCRIPTION' THEN logs ELSE n END AS events FROM n, (VALUES ('FORMAT_DESCRIPTION'), ('GTID'), ('QUERY'), ('TABLE_MAP'), ('XID')) t(name)
UNION ALL SELECT CASE event_type WHEN 'signup' THEN 'WRITE_ROWS' WHEN 'error' THEN 'DELETE_ROWS' ELSE 'UPDATE_ROWS' END, count(*) FROM events GROUP BY 1""")
def event_table_function(spark, sf_dir):
    binlog.event_function(spark)
    logs(spark, sf_dir).createOrReplaceTempView("tidelog_logs")
    return spark.sql("SELECT e.event_name, count(*) AS events FROM tidelog_logs l, LATERAL binlog_events(l.data) e GROUP BY 1")


@query("SELECT event_id, '<' || upper(event_type) || '>' AS event_type FROM events WHERE event_type = 'signup'")
def own_cell_decoder(spark, sf_dir):
    """A decoder of one's own for short texts, of a higher priority than another."""
    own = Decoders()
    own.register_type(15, "plain", lambda cursor, column: cursor.take(cursor.uint(2 if column.meta > 255 else 1)).decode(), 1)
    own.register_type(15, "loud", lambda cursor, column: f"<{cursor.take(cursor.uint(2 if column.meta > 255 else 1)).decode().upper()}>", 5)
    feed = binlog.changes(binlog.decode_logs(logs(spark, sf_dir), "data", "file", types={30}, decoders=own, columns=binlog.CHANGED["columns"]))
    return binlog.typed(feed.where("op = 'INSERT'"), [("event_id", "bigint"), ("user_id", "string"), ("event_type", "string")], keep=()).drop("user_id")


@query("""WITH e AS (SELECT user_id % 3 AS t, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS i FROM events)
SELECT 't' || t AS table_name, (i - 1) // 100 + 1 AS segment_id, count(*) AS entries, min(i) AS first_index, max(i) AS last_index, true AS crc_ok, 'db#t' || t || '/rlog-1-' || ((i - 1) // 100 + 1) || '-' || min(i) || '.log' AS name FROM e GROUP BY t, 2""")
def relay_storage(spark, sf_dir):
    """Records written to segments and read back, checked."""
    folder = scratch.folder(spark, "relay")
    rows = records(spark, sf_dir).withColumn("table_name", F.concat(F.lit("t"), (F.col("key") % 3).cast("string"))).withColumn("database_name", F.lit("db"))
    entries = relay.segments_by_entries(relay.numbered(rows, ["database_name", "table_name"], "event_log_pos", span=1 << 12))
    relay.write(entries, folder)
    found = relay.read(spark, folder).groupBy("database_name", "table_name", F.col("segment_id").cast("long").alias("segment_id"))
    out = found.agg(F.count("*").alias("entries"), F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.min("crc_ok").alias("crc_ok"))
    return out.withColumn("name", relay.segment_path(F.col("database_name"), F.col("table_name"), F.lit(1), F.col("segment_id"), F.col("first_index"))).drop("database_name")


class _Log(RowHandler):
    """Writes a line for each batch."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def start(self, batch_id: int) -> None:
        self.lines.append(f"start {batch_id}")

    def end(self, batch_id: int) -> None:
        self.lines.append(f"end {batch_id}")


@query(f"SELECT lower({_OP}) AS op, count(*) AS rows FROM events GROUP BY 1 UNION ALL SELECT 'batches', 1")
def handler_counts(spark, sf_dir):
    """A stream's batches given to two handlers in turn: one counts, one logs."""
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    counting, log = CountingHandler(), _Log()
    handled(stream(spark, sf_dir, "events").withColumn("op", op), [counting, log]).trigger(availableNow=True).start().awaitTermination()
    found = {**counting.counts, "batches": sum(x.startswith("end") for x in log.lines)}
    return spark.createDataFrame(sorted(found.items()), "op string, rows long")


@query("SELECT n_nationkey AS shard, count(*) AS suppliers, max(s_suppkey) AS newest FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def schemas_with_tables(spark, sf_dir):
    """Schemas that no table has are left out; the rest with what their tables say."""
    tables = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("database_name"), "s_suppkey")
    schemas = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("database_name")).unionByName(spark.range(100, 110).select(F.col("id").cast("int").alias("database_name")))
    kept = catalog.without_empty(schemas, tables)
    return kept.join(tables, "database_name").groupBy(F.col("database_name").alias("shard")).agg(F.count("*").alias("suppliers"), F.max("s_suppkey").alias("newest"))
