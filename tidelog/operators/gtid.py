"""Sets of global transaction ids: (source, start, end) rows, both ends included.

Intervals merge where they overlap or touch (start <= end + 1). Merging orders the intervals of a source; as a source may
hold most of a log, its numbers are cut into ranges: intervals merge inside a range first, and where a merged interval begins
anew, in the order of its whole source, is found range by range, with one carried row for each. So is what a sweep over two
sets' ends has counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import ordered
from tidelog.operators.ordered import with_interval
from tidelog.sources.scratch import cut

SPAN = 1 << 20


def singles(df: DataFrame, source: Column, number: Column) -> DataFrame:
    """Transactions as intervals of one number."""
    return df.select(source.alias("source"), number.cast("long").alias("start"), number.cast("long").alias("end"))


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge(intervals: DataFrame, span: int = SPAN) -> DataFrame:
    """The fewest intervals that hold the same numbers. Empty intervals (start > end) and nulls hold none."""
    real = intervals.select("source", "start", "end").where("start <= end")  # equal ones merge like others; finding them first would hold all in memory
    inside = _merge(real.withColumn("_range", F.floor(F.col("start") / span)), ["source", "_range"]).drop("_range")
    inside = cut(inside)  # read for the intervals and for what is carried between ranges
    reached = ordered.with_greatest_before(inside, ["source"], "start", "end", "_before", span)
    new = F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before") + 1), 1).otherwise(0).cast("long")
    numbered = ordered.with_running(reached, ["source"], "start", {"_island": new}, span)
    return numbered.groupBy("source", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def contains(rows: DataFrame, intervals: DataFrame, source: str, number: str, covered: bool = True, span: int = SPAN) -> DataFrame:
    """Rows whose transaction the set holds, or, with covered=False, those it doesn't (a null is in no set)."""
    found = with_interval(rows, [source], number, merge(intervals).withColumnRenamed("source", source), "_held", span)
    return found.where(F.col("_held").isNotNull() if covered else F.col("_held").isNull()).drop("_held")


def union(a: DataFrame, b: DataFrame, span: int = SPAN) -> DataFrame:
    return merge(a.select("source", "start", "end").unionByName(b.select("source", "start", "end")), span)


def _swept(a: DataFrame, b: DataFrame, span: int) -> DataFrame:
    """Pieces of the numbers between all ends, with whether each set holds them: a sweep over both sets' ends."""
    ends = lambda s, k: s.select("source", F.col("start").alias("at"), F.lit(1).alias(f"d{k}"), F.lit(0).alias(f"d{1 - k}")).unionByName(s.select("source", (F.col("end") + 1).alias("at"), F.lit(-1).alias(f"d{k}"), F.lit(0).alias(f"d{1 - k}")))
    steps = ends(merge(a, span), 0).unionByName(ends(merge(b, span), 1)).groupBy("source", "at").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    held = ordered.with_running(cut(steps), ["source"], "at", {"n0": F.col("d0"), "n1": F.col("d1")}, span)
    pieces = ordered.with_previous(cut(held.select("source", "at", "n0", "n1")), ["source"], "at", ["at", "n0", "n1"], "p", span).where(F.col("p").isNotNull())
    return pieces.select("source", F.col("p.at").alias("start"), (F.col("at") - 1).alias("end"), (F.col("p.n0") > 0).alias("in_a"), (F.col("p.n1") > 0).alias("in_b"))


def intersect(a: DataFrame, b: DataFrame, span: int = SPAN) -> DataFrame:
    return merge(_swept(a, b, span).where("in_a and in_b"), span)


def difference(a: DataFrame, b: DataFrame, span: int = SPAN) -> DataFrame:
    return merge(_swept(a, b, span).where("in_a and not in_b"), span)


def rendered(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def set_text(intervals: DataFrame) -> DataFrame:
    """One row a source: ``source:1-3:5``, intervals in order. A source's text is as long as its set."""
    parts = F.array_sort(F.collect_list(F.struct("start", "end")))
    joined = F.concat_ws(":", F.transform(parts, lambda p: rendered(p["start"], p["end"])))
    return merge(intervals).groupBy("source").agg(joined.alias("text")).select("source", F.concat_ws(":", F.col("source").cast("string"), "text").alias("gtid_set"))


def parse(sets: DataFrame, text: str = "gtid_set") -> DataFrame:
    """(source, start, end) of ``uuid:1-3:5,uuid:7``; single numbers are intervals of one, what isn't a number is left out."""
    entries = sets.select(F.explode(F.split(F.col(text), r"\s*,\s*")).alias("entry"))
    spans = entries.select(F.trim(F.substring_index("entry", ":", 1)).alias("source"), F.explode(F.slice(F.split("entry", ":"), 2, F.size(F.split("entry", ":")))).alias("span"))
    start, end = F.substring_index("span", "-", 1).try_cast("bigint"), F.substring_index("span", "-", -1).try_cast("bigint")
    return spans.select("source", start.alias("start"), end.alias("end")).where("start is not null and end is not null and start <= end")


def count(intervals: DataFrame) -> DataFrame:
    """One row a source: transactions, intervals, and transactions an interval."""
    return merge(intervals).groupBy("source").agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("transactions"), F.count("*").alias("intervals"), (F.sum(F.col("end") - F.col("start") + 1) / F.count("*")).alias("ratio"),
    )


def uuid_text(data: Column) -> Column:
    """16 bytes as a UUID's text."""
    h = F.lower(F.hex(data))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def uuid_bytes(text: Column) -> Column:
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def running(log: DataFrame, source: str, number: str, order: str, span: int = ordered.SPAN) -> DataFrame:
    """log with the transactions and the intervals of its source's executed set as it stands after each row.

    Numbers rise within a source; a number that doesn't follow the one before begins an interval.
    """
    found = ordered.with_previous(log, [source], order, [number], "_before", span)
    new = F.when(F.col(number) == F.col(f"_before.{number}") + 1, 0).otherwise(1).cast("long")
    return ordered.with_running(found.withColumn("_new", new), [source], order, {"transactions": F.lit(1).cast("long"), "intervals": F.col("_new")}, span).drop("_before", "_new")


def snapshots(log: DataFrame, source: str, order: str, every: int = 1000, keep: int = 10, span: int = ordered.SPAN) -> DataFrame:
    """The rows at which a source's set is kept: each `every`-th transaction, the newest `keep` of them; the last one is what is restored."""
    from tidelog.operators.relay import newest

    counted = ordered.with_number(log, [source], order, "transactions", span)
    return newest(counted.where(F.col("transactions") % every == 0), [source], [F.desc("transactions")], keep)
