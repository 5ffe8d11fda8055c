"""Relay records: target-neutral changes in numbered, segmented storage, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordered import SPAN, with_interval, with_number, with_running

SEGMENT_ENTRIES, SEGMENT_BYTES, RING = 100, 10 << 20, 1024
#: Neighbouring segments of a table that are dealt to one task.
DEALT = 1024


def records(feed: DataFrame, database: str, table: str, order: str = "event_id") -> DataFrame:
    """Relay records of a feed: src_type, position, names, command, payload (JSON of the images) and its CRC-32."""
    payload = F.to_json(F.struct("before", "after"), {"ignoreNullFields": "false"})
    command = F.when(F.col("op").isin("INSERT", "UPDATE", "DELETE"), F.col("op")).otherwise("NONE")
    out = feed.select(
        F.lit("MYSQL").alias("src_type"), F.col(order).alias("event_log_pos"), F.lit(database).alias("database_name"), F.lit(table).alias("table_name"),
        command.alias("command"), "key", payload.alias("payload"),
    )
    return out.withColumn("log_size", F.octet_length("payload").cast("long")).withColumn("crc", F.crc32(F.col("payload").cast("binary")))


def numbered(entries: DataFrame, table: list[str], order: str, span: int = SPAN) -> DataFrame:
    """Entries with their dense index in their table, from 1."""
    return with_number(entries, table, order, "index", span)


def segments_by_entries(entries: DataFrame, size: int = SEGMENT_ENTRIES) -> DataFrame:
    """segment_id of numbered entries: a segment holds `size` of them."""
    return entries.withColumn("segment_id", F.floor((F.col("index") - 1) / size) + 1)


def segments_by_bytes(entries: DataFrame, table: list[str], order: str, size: int = SEGMENT_BYTES, span: int = SPAN) -> DataFrame:
    """segment_id by running bytes: an entry belongs to the segment that the bytes before it have reached."""
    summed = with_running(entries, table, order, {"_bytes": F.col("log_size")}, span)
    return summed.withColumn("segment_id", F.floor((F.col("_bytes") - F.col("log_size")) / size) + 1).drop("_bytes")


def segment_table(entries: DataFrame, table: list[str]) -> DataFrame:
    """One row a segment: first and last index, entries, bytes, whether it is full."""
    out = entries.groupBy(*table, "segment_id").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.count("*").alias("entries"), F.sum("log_size").alias("bytes"))
    return out.withColumn("full", (F.col("entries") >= SEGMENT_ENTRIES) | (F.col("bytes") >= SEGMENT_BYTES))


def lookup(wanted: DataFrame, segments: DataFrame, table: list[str], span: int = SPAN) -> DataFrame:
    """wanted (table, index) with segment_id, first_index and last_index of the segment that holds it; others are left out."""
    spans = segments.select(*table, F.col("first_index").alias("start"), F.col("last_index").alias("end"), "segment_id")
    found = with_interval(wanted, table, "index", spans, "_segment", span).where(F.col("_segment").isNotNull())
    return found.select(*wanted.columns, "_segment.segment_id", F.col("_segment.start").alias("first_index"), F.col("_segment.end").alias("last_index"))


def ring(entries: DataFrame, table: list[str], slots: int = RING) -> DataFrame:
    """What a ring of slots holds: the newest entry of each slot (index mod slots)."""
    names = [c for c in entries.columns if c not in table]
    return entries.groupBy(*table, F.pmod("index", F.lit(slots)).alias("slot")).agg(F.max_by(F.struct(*names), "index").alias("e")).select(*table, "slot", "e.*")


def apply(records_: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table that a feed leaves: each key's last record, unless that is a delete. A partial aggregate, not a window."""
    names = [c for c in records_.columns if c not in keys]
    last = records_.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(order)).alias("e")).select(*keys, "e.*")
    return last.where("op <> 'DELETE'")


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each group (snapshots kept, cache eviction)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def verify(entries: DataFrame) -> DataFrame:
    """Entries with crc_ok: whether the payload still has its checksum."""
    return entries.withColumn("crc_ok", F.crc32(F.col("payload").cast("binary")) == F.col("crc"))


def write(entries: DataFrame, path: str) -> None:
    """Append to partitioned storage: a folder a table, entries in order, many segments in a file (its statistics tell which).

    A file for each segment would be as many files as segments, to make, to list and to open.
    """
    deal = entries.repartition("database_name", "table_name", F.floor((F.col("segment_id") - 1) / DEALT)).sortWithinPartitions("database_name", "table_name", "segment_id", "index")
    deal.write.mode("append").partitionBy("database_name", "table_name").parquet(path)


def segment_path(database: Column, table: Column, version: Column, segment: Column, first_index: Column) -> Column:
    """``database#table/rlog-<version>-<segment>-<first index>.log``."""
    return F.concat(database, F.lit("#"), table, F.lit("/rlog-"), F.concat_ws("-", version.cast("string"), segment.cast("string"), first_index.cast("string")), F.lit(".log"))


def read(spark, path: str) -> DataFrame:
    """Entries of a storage folder, checked."""
    return verify(spark.read.parquet(path))


def retain(entries: DataFrame, table: list[str], segments: int) -> DataFrame:
    """Entries of each table's last `segments` segments."""
    last = entries.groupBy(*table).agg(F.max("segment_id").alias("_last"))
    return entries.join(last, table).where(F.col("segment_id") > F.col("_last") - segments).drop("_last")
