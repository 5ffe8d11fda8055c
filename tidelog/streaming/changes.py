"""The operators on streams.

Log order is the order of truth, so rows carry their place; event time is only used for windows. State is kept per key:
the last image of a row, the table map of a table, the merged intervals of a source. Streams that are stateless, and
aggregates with a watermark, use Spark's own operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidelog.functions.measures import share


def rates(log: DataFrame, ts: str, by: list[str], width: str, late: str, size: Column, slide: str | None = None) -> DataFrame:
    """Events, bytes and rate of tumbling (or sliding) windows; rows later than the watermark are left out."""
    windows = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = log.withWatermark(ts, late).groupBy(windows.alias("w"), *by).agg(F.count("*").alias("events"), F.sum(size).cast("long").alias("bytes"))
    seconds = (F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1e6
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events", "bytes", (F.col("events") / seconds).alias("events_per_second"))


def sessions(log: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    out = log.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def running_stats(log: DataFrame, by: list[str], size: Column, failed: Column) -> DataFrame:
    """Running totals by kind, for the update or complete mode."""
    out = log.groupBy(*by).agg(F.count_if(~failed).alias("events"), F.count_if(failed).alias("errors"), F.sum(size).cast("long").alias("bytes"))
    return out.withColumn("success_rate", share(F.col("events"), F.col("events") + F.col("errors"), 100.0))


class LastImage(StatefulProcessor):
    """Each row with the image of its key before it; rows of a batch are taken in the order of their places."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.image = handle.getValueState("image", "pos long, cells array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("pos", kind="stable")
        pos, cells = self.image.get() if self.image.exists() else (-1, None)
        before = []
        for p, after in zip(found["pos"], found["after"], strict=True):
            before.append(None if cells is None else list(cells))
            if p > pos:
                pos, cells = int(p), list(after)
        self.image.update((pos, cells))
        yield pd.DataFrame({"key": [key[0]] * len(found), "pos": found["pos"], "before": before, "after": [list(a) for a in found["after"]]})

    def close(self) -> None:
        pass


def with_images(feed: DataFrame) -> DataFrame:
    """A stream (key, pos, after) with the image before. Places rise from batch to batch within a key."""
    return feed.select("key", "pos", "after").groupBy("key").transformWithStateInPandas(LastImage(), "key long, pos long, before array<string>, after array<string>", "Append", "None")


class TransactionSet(StatefulProcessor):
    """The merged intervals of a source, as they stand after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getListState("spans", "start long, end long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        spans = [(int(a), int(b)) for a, b in self.spans.get()] if self.spans.exists() else []
        for part in rows:
            spans += [(int(n), int(n)) for n in part["number"]]
        merged: list[tuple[int, int]] = []
        for start, end in sorted(spans):
            if merged and start <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(merged[-1][1], end))
            else:
                merged.append((start, end))
        self.spans.put(merged)
        text = ":".join(str(s) if s == e else f"{s}-{e}" for s, e in merged)
        yield pd.DataFrame({"source": [key[0]], "gtid_set": [f"{key[0]}:{text}"], "transactions": [sum(e - s + 1 for s, e in merged)]})

    def close(self) -> None:
        pass


def transaction_sets(log: DataFrame) -> DataFrame:
    """A stream (source, number) as executed sets: a row for each source of each batch."""
    return log.select("source", "number").groupBy("source").transformWithStateInPandas(TransactionSet(), "source string, gtid_set string, transactions long", "Update", "None")


class RowHandler:
    """What is called with the rows of each micro-batch; every method may be left as it is."""

    def start(self, batch_id: int) -> None: ...

    def insert(self, rows: DataFrame) -> None: ...

    def update(self, rows: DataFrame) -> None: ...

    def delete(self, rows: DataFrame) -> None: ...

    def end(self, batch_id: int) -> None: ...

    def error(self, batch_id: int, problem: Exception) -> None: ...


class CountingHandler(RowHandler):
    def __init__(self) -> None:
        self.counts = {"insert": 0, "update": 0, "delete": 0}

    def insert(self, rows: DataFrame) -> None:
        self.counts["insert"] += rows.count()

    def update(self, rows: DataFrame) -> None:
        self.counts["update"] += rows.count()

    def delete(self, rows: DataFrame) -> None:
        self.counts["delete"] += rows.count()


class TableHandler(RowHandler):
    """Passes only the rows of one table on."""

    def __init__(self, table: str, inner: RowHandler):
        self.table, self.inner = table, inner

    def insert(self, rows: DataFrame) -> None:
        self.inner.insert(rows.where(F.col("table_name") == self.table))

    def update(self, rows: DataFrame) -> None:
        self.inner.update(rows.where(F.col("table_name") == self.table))

    def delete(self, rows: DataFrame) -> None:
        self.inner.delete(rows.where(F.col("table_name") == self.table))


def handled(feed: DataFrame, handlers: list[RowHandler]) -> DataStreamWriter:
    """A writer that gives each batch's rows to the handlers in turn; the first error is told to all, and ends the query."""

    def call(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for h in handlers:
                h.start(batch_id)
                for op, method in (("INSERT", h.insert), ("UPDATE", h.update), ("DELETE", h.delete)):
                    method(kept.where(F.col("op") == op))
                h.end(batch_id)
        except Exception as problem:
            for h in handlers:
                h.error(batch_id, problem)
            raise
        finally:
            kept.unpersist()

    return feed.writeStream.foreachBatch(call)


def to_segments(records: DataFrame, path: str) -> DataStreamWriter:
    """Relay records appended batch by batch; a batch that is run again replaces its own folder, so nothing is written twice."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("database_name", "table_name").parquet(f"{path}/batch={batch_id}")

    return records.writeStream.foreachBatch(append)


class ProgressLog(StreamingQueryListener):
    """Rows and rates of every batch, and calls by name when a query ends."""

    def __init__(self) -> None:
        self.progress: list[dict] = []
        self.on_end: dict[str, Callable[[str], None]] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.progress.append({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        for call in self.on_end.values():
            call(str(event.id))
