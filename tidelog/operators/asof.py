"""As-of joins over a log: table maps, transaction ids, table versions, transaction spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import SPAN, with_last_seen, with_number, with_running


def with_table_map(log: DataFrame, keys: list[str], order: str, is_map: Column, is_end: Column | None, value: Column, out: str = "table_map", span: int = SPAN) -> DataFrame:
    """Each row with the table map that holds there: the last one before it, unless a statement's end came in between.

    value: what a map row holds. With is_end, a row of that kind clears the maps after itself.
    """
    if is_end is None:
        return with_last_seen(log, keys, order, F.when(is_map, value), out, span)
    # a statement is told by the ends before it; an end's own row still belongs to the statement that it ends
    ends = with_running(log, keys, order, {"_ends": F.when(is_end, 1).otherwise(0).cast("long")}, span)
    numbered = ends.withColumn("_statement", F.col("_ends") - F.when(is_end, 1).otherwise(0))
    seen = with_last_seen(numbered, keys, order, F.when(is_map, F.struct(F.col("_statement").alias("statement"), value.alias("value"))), "_map", span)
    return seen.withColumn(out, F.when(F.col("_map.statement") == F.col("_statement"), F.col("_map.value"))).drop("_map", "_ends", "_statement")


def with_transaction(log: DataFrame, keys: list[str], order: str, gtid: Column, out: str = "gtid", span: int = SPAN) -> DataFrame:
    """Each row stamped with the last transaction id seen; gtid is null on rows that aren't one."""
    return with_last_seen(log, keys, order, gtid, out, span)


def with_transaction_number(log: DataFrame, keys: list[str], order: str, begins: Column, out: str = "txn", span: int = SPAN) -> DataFrame:
    """Each row with the number of transactions begun so far."""
    return with_running(log, keys, order, {out: F.when(begins, 1).otherwise(0).cast("long")}, span)


def transaction_spans(log: DataFrame, keys: list[str], order: str, begins: Column, span: int = SPAN) -> DataFrame:
    """One row a transaction: its first and last place and its number of rows; rows before the first one have number 0."""
    return with_transaction_number(log, keys, order, begins, "txn", span).groupBy(*keys, "txn").agg(
        F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.count("*").alias("events"),
    )


def table_versions(maps: DataFrame, table: list[str], order: str, span: int = SPAN) -> DataFrame:
    """Table maps with their version: the how-manieth of their table they are."""
    return with_number(maps, table, order, "version", span)


def changed_tables(expected: DataFrame, versions: DataFrame, table: list[str]) -> DataFrame:
    """expected (table, expected_version) with current_version and changed; a table that is not known has changed."""
    current = versions.groupBy(*table).agg(F.max("version").alias("current_version"))
    return expected.join(current, table, "left").withColumn("changed", F.coalesce(F.col("current_version") != F.col("expected_version"), F.lit(True)))


def named_columns(maps: DataFrame, definitions: DataFrame, name: str = "table_name") -> DataFrame:
    """Table maps with column names of the definition of the same table, only where it has as many columns.

    maps: name, types array; definitions: name, names array.
    """
    named = definitions.select(F.col(name).alias("_name"), F.col("names").alias("_names"))
    joined = maps.join(named, (F.col(name) == F.col("_name")) & (F.size("_names") == F.size("types")), "left")
    return joined.withColumn("columns", F.when(F.col("_names").isNotNull(), F.arrays_zip(F.col("_names").alias("name"), F.col("types").alias("type")))).drop("_name", "_names")


def with_charsets(columns: Column, default: int, exceptions: Column) -> Column:
    """Character columns with their character set: of the map exceptions (place -> id), else the default."""
    return F.transform(columns, lambda c, i: F.struct(c.alias("column"), F.coalesce(F.element_at(exceptions, i), F.lit(default)).alias("charset")))
