"""Queries of streams. A table's files are the stream; all of it is read by one trigger, into files of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.plans.registry import query, read
from tidelog.sources import scratch
from tidelog.streaming import changes


def stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a stream; its folder may hold others, so the file is named by a pattern."""
    table = read(spark, sf_dir, name)
    return spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once it has read everything. Executors write its batches; a complete one stands for all before it."""
    folder = scratch.folder(stream.sparkSession, "drained")
    kept: list[str] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        kept.append(f"{folder}/{batch_id}")
        batch.write.mode("overwrite").parquet(kept[-1])

    stream.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not kept:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(*(kept[-1:] if mode == "complete" else dict.fromkeys(kept)))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, sum(octet_length(encode(props)))::BIGINT AS bytes, round(count(*) / 3600, 6) AS events_per_second FROM events GROUP BY 1, 2""")
def stream_windowed_rates(spark, sf_dir):
    out = drained(changes.rates(stream(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "10 minutes", F.octet_length("props")), "complete")
    return _plain(out).select("window_start", "event_type", "events", "bytes", F.round("events_per_second", 6).alias("events_per_second"))


@query("""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    return _plain(drained(changes.sessions(stream(spark, sf_dir, "events"), "ts", "user_id", "30 minutes", "10 minutes"), "complete"))


@query("SELECT event_type, count(*) FILTER (value < 90) AS events, count(*) FILTER (value >= 90) AS errors, sum(octet_length(encode(props)))::BIGINT AS bytes, round(100.0 * count(*) FILTER (value < 90) / count(*), 4)::DOUBLE AS success_rate FROM events GROUP BY 1")
def stream_running_stats(spark, sf_dir):
    out = drained(changes.running_stats(stream(spark, sf_dir, "events"), ["event_type"], F.octet_length("props"), F.col("value") >= 90), "complete")
    return out.withColumn("success_rate", F.round("success_rate", 4))
