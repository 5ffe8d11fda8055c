"""Cells of the log as values of target rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MILLIS = 86_400_000


def day_millis(text: Column) -> Column:
    """Milliseconds since midnight of an ``hh:mm:ss[.fraction]`` of one day; null for others."""
    pattern = r"^(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    h, m, s = (part(k).try_cast("long") for k in (1, 2, 3))
    millis = F.substring(F.rpad(part(4), 3, "0"), 1, 3).try_cast("long")
    return F.when(text.rlike(pattern) & (h < 24) & (m < 60) & (s < 60), ((h * 60 + m) * 60 + s) * 1000 + F.coalesce(millis, F.lit(0)))


def epoch_millis(text: Column, kind: str, today: str = "1970-01-01") -> Column:
    """Milliseconds since 1970 of a date, a date and time, or a time (of the day `today`); null where it is none.

    No time zone takes part: texts are read as UTC.
    """
    if kind == "time":
        return F.unix_date(F.lit(today).cast("date")).cast("long") * DAY_MILLIS + day_millis(text)
    day = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("long") * DAY_MILLIS
    if kind == "date":
        return F.when(F.length(text) == 10, day)
    return F.when(F.length(text) > 10, day + day_millis(F.substring(text, 12, 15))).when(F.length(text) == 10, day)


def target_value(text: Column, source: Column, today: str = "1970-01-01") -> Column:
    """A cell's text as that of its target value: whole numbers in range, temporal values as epoch milliseconds.

    Bits, enumerations and sets have no target value: null. So have numbers out of range and dates that don't exist.
    """
    whole = lambda kind: text.try_cast(kind).cast("string")
    millis = lambda kind: epoch_millis(text, kind, today).cast("string")
    return (
        F.when(source.isin("TINY", "SHORT", "INT24", "LONG", "YEAR"), whole("int")).when(source == "LONGLONG", whole("bigint"))
        .when(source.isin("DATE", "NEWDATE"), millis("date")).when(source.isin("TIME", "TIME2"), millis("time"))
        .when(source.isin("DATETIME", "DATETIME2", "TIMESTAMP", "TIMESTAMP2"), millis("datetime"))
        .when(source.isin("BIT", "ENUM", "SET", "NULL"), F.lit(None).cast("string")).otherwise(text)
    )


def trimmed_decimal(text: Column) -> Column:
    """A decimal's text without zeros at the end of its fraction, and without an empty fraction."""
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def enum_label(labels: Column, value: Column) -> Column:
    """The label of an enumeration's number, from 1; '' for 0 and numbers that have none."""
    return F.coalesce(F.get(labels, value.cast("int") - 1), F.lit(""))


def set_labels(labels: Column, value: Column) -> Column:
    """The labels of a set's bits, comma-joined."""
    return F.array_join(F.filter(labels, lambda x, i: F.call_function("shiftright", value.cast("long"), i).bitwiseAND(1) == 1), ",")
