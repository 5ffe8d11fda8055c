"""Streams give what the same operator gives on a table."""

import pytest
from pyspark.sql import functions as F

from tidelog.plans.streams import drained
from tidelog.streaming import changes


@pytest.fixture
def feed_stream(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 1, "INSERT", "t", ["a"]), (2, 2, "INSERT", "u", ["x"]), (1, 3, "UPDATE", "t", ["b"]), (1, 4, "DELETE", "t", ["c"]), (2, 5, "UPDATE", "u", ["y"])],
        "key long, pos long, op string, table_name string, after array<string>",
    )
    for low, high in ((0, 3), (3, 9)):  # two files, a batch each
        rows.where((F.col("pos") > low) & (F.col("pos") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))


def test_images_are_kept_between_batches(spark, feed_stream, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drained(changes.with_images(feed_stream), "append").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r.pos: (r.before, r.after) for r in got} == {1: (None, ["a"]), 2: (None, ["x"]), 3: (["a"], ["b"]), 4: (["b"], ["c"]), 5: (["x"], ["y"])}


def test_executed_sets(spark, feed_stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        log = feed_stream.select(F.concat(F.lit("s"), F.col("key").cast("string")).alias("source"), F.col("pos").alias("number"))
        got = drained(changes.transaction_sets(log), "update").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {max((r.transactions, r.gtid_set) for r in got if r.source == s) for s in ("s1", "s2")} == {(3, "s1:1:3-4"), (2, "s2:2:5")}


def test_handlers(spark, feed_stream, tmp_path):
    counting, only_t = changes.CountingHandler(), changes.CountingHandler()
    writer = changes.handled(feed_stream, [counting, changes.TableHandler("t", only_t)])
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert counting.counts == {"insert": 2, "update": 2, "delete": 1} and only_t.counts == {"insert": 1, "update": 1, "delete": 1}


def test_an_error_of_a_handler_ends_the_query(feed_stream, tmp_path):
    told = []

    class Broken(changes.RowHandler):
        def update(self, rows):
            raise ValueError("broken")

        def error(self, batch_id, problem):
            told.append(str(problem))

    query = changes.handled(feed_stream, [Broken()]).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="broken"):
        query.awaitTermination()
    assert told == ["broken"]


def test_segments_are_written_once(spark, feed_stream, tmp_path):
    records = feed_stream.withColumn("database_name", F.lit("d"))
    for _ in range(2):
        changes.to_segments(records, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_progress_is_kept(spark, feed_stream, tmp_path):
    log, ended = changes.ProgressLog(), []
    log.on_end["mine"] = ended.append
    spark.streams.addListener(log)
    try:
        drained(feed_stream, "append")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert sum(p["rows"] for p in log.progress) == 5
    finally:
        spark.streams.removeListener(log)


def test_what_is_drained_lies_in_files(spark, feed_stream):
    """Not in the driver's memory; of two complete batches the last one stands."""
    every = drained(feed_stream, "append")
    assert every.inputFiles() and sorted(r.pos for r in every.collect()) == [1, 2, 3, 4, 5]
    counted = drained(feed_stream.groupBy("op").count(), "complete")
    assert counted.inputFiles() and {tuple(r) for r in counted.collect()} == {("INSERT", 2), ("UPDATE", 2), ("DELETE", 1)}
