"""Change feeds: rows of a log as inserts, updates and deletes with images before and after.

A feed has event_id (its place in the log), key (the row that changes), op, and before and after as arrays of text, one
cell a column, null where the image is absent. Every operator of this package takes any DataFrame with these columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import with_previous

#: Which operation each type of the events table stands for.
OPERATIONS = {"signup": "INSERT", "error": "DELETE"}
FIELDS = ("event_type", "value", "props")


def operation(event_type: Column) -> Column:
    out = F.lit("UPDATE")
    for name, op in OPERATIONS.items():
        out = F.when(event_type == name, op).otherwise(out)
    return out


def image(columns: list[Column]) -> Column:
    return F.array(*(c.cast("string") for c in columns))


def from_events(events: DataFrame) -> DataFrame:
    """(event_id, ts, key, op, before, after): each user's events as versions of one row; the first has no image before."""
    cells = events.select("event_id", "ts", F.col("user_id").alias("key"), operation(F.col("event_type")).alias("op"), image([F.col("event_type"), F.col("value").cast("decimal(18,4)"), F.col("props")]).alias("after"))
    found = with_previous(cells, ["key"], "event_id", ["after"])
    return found.select("event_id", "ts", "key", "op", F.col("previous.after").alias("before"), "after")


def from_snapshot(df: DataFrame, order: list[str], table: str) -> DataFrame:
    """A table's rows as inserts: (database_name, table_name, op, row_key, after)."""
    return df.select(
        F.lit("default").alias("database_name"), F.lit(table).alias("table_name"), F.lit("INSERT").alias("op"),
        F.concat_ws(":", *(F.col(c).cast("string") for c in order)).alias("row_key"), image([F.col(c) for c in df.columns]).alias("after"),
    )
