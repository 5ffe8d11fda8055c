"""Buckets, percentages and error classes of parsing statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (inclusive) and labels of the size, large-object and percentage histograms.
SIZE_BUCKETS = ((100, "0-100B"), (1000, "101B-1KB"), (10_000, "1-10KB"), (100_000, "10-100KB"), (1_000_000, "100KB-1MB"), (None, ">1MB"))
LOB_BUCKETS = ((1024, "0-1KB"), (10_240, "1-10KB"), (102_400, "10-100KB"), (1_048_576, "100KB-1MB"), (10_485_760, "1-10MB"), (None, ">10MB"))
PERCENT_BUCKETS = ((10, "0-10%"), (25, "11-25%"), (50, "26-50%"), (75, "51-75%"), (90, "76-90%"), (None, "91-100%"))
# Marks in an error's message and its class, in this order.
ERROR_MARKS = (("io:", "IO Error"), ("parse", "Parse Error"), ("decode", "Parse Error"), ("memory", "Memory Error"), ("timeout", "Timeout Error"))
# Error kinds after which parsing can go on.
RECOVERABLE = ("UnsupportedEventType", "InvalidDataFormat", "EventParseError", "ChecksumMismatch", "TableMapNotFound")
FATAL = ("Bug", "Failure", "MemoryLimitExceeded")


def bucket(value: Column, bounds: tuple) -> Column:
    out = F.lit(bounds[-1][1])
    for limit, label in reversed(bounds[:-1]):
        out = F.when(value <= limit, label).otherwise(out)
    return out


def percent_bucket(percent: Column) -> Column:
    """Percentages are cut to whole ones first."""
    return bucket(percent.cast("int"), PERCENT_BUCKETS)


def bucket_sql(value: str, bounds: tuple) -> str:
    """The same buckets as a CASE of SQL."""
    return "CASE " + " ".join(f"WHEN {value} <= {limit} THEN '{label}'" for limit, label in bounds[:-1]) + f" ELSE '{bounds[-1][1]}' END"


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """100 * part / whole; `empty` where the whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(100.0 * part / whole)


def error_category(message: Column) -> Column:
    out = F.lit("General Error")
    for mark, name in reversed(ERROR_MARKS):
        out = F.when(F.contains(message, F.lit(mark)), name).otherwise(out)
    return F.when(message.isNull(), "Unknown Error").otherwise(out)


def is_recoverable(kind: Column) -> Column:
    return F.coalesce(kind.isin(*RECOVERABLE), F.lit(False))


def is_error(kind: Column) -> Column:
    return F.coalesce(kind.isin(*RECOVERABLE, *FATAL), F.lit(False))
