"""Order-dependent operators over a log: previous row, last seen value, running sums, row numbers.

A window over a whole table or file puts it in one task. Here the order column (a long: a position, an event id) is cut
into ranges of `span` positions, and a window runs inside each (key, range). What a range needs from those before it,
its last row or its sum, is aggregated into one small row per range, and a window over those rows carries it on. So a
key that holds a third of the log is as many groups as it has ranges, and the carry is `span` times smaller than the log.

Positions must be unique within a key, as log positions are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 20
_RANGE = "_range"


def _ranged(df: DataFrame, order: str, span: int) -> DataFrame:
    return df.withColumn(_RANGE, F.floor(F.col(order) / span))


def _join_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """df with the carry of its (key, range); keys may be null."""
    names = {c: f"_k{i}" for i, c in enumerate([*keys, _RANGE])}
    small = carry.select(*(F.col(c).alias(n) for c, n in names.items()), "_carry")
    met = None
    for c, n in names.items():
        test = F.col(c).eqNullSafe(F.col(n)) if c != _RANGE else F.col(c) == F.col(n)
        met = test if met is None else met & test
    return df.join(small, met, "left").drop(*names.values())


def with_previous(df: DataFrame, keys: list[str], order: str, columns: list[str], out: str = "previous", span: int = SPAN) -> DataFrame:
    """df with a struct of the columns of the row before, in the order of its key; null for a key's first row."""
    ranged = _ranged(df, order, span)
    own = F.struct(*columns)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(order)
    last = ranged.groupBy(*keys, _RANGE).agg(F.max_by(own, F.col(order)).alias("_last"))
    carry = last.select(*keys, _RANGE, F.lag("_last").over(Window.partitionBy(*keys).orderBy(_RANGE)).alias("_carry"))
    found = ranged.withColumn(out, F.lag(own).over(inside)).withColumn("_n", F.row_number().over(inside))
    return _join_carry(found, carry, keys).withColumn(out, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col(out))).drop("_carry", "_n", _RANGE)


def with_last_seen(df: DataFrame, keys: list[str], order: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """df with the last value that wasn't null, up to and including each row: an as-of join of a log with itself."""
    ranged = _ranged(df.withColumn("_value", value), order, span)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = ranged.groupBy(*keys, _RANGE).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, _RANGE, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    found = ranged.withColumn(out, F.last("_value", ignorenulls=True).over(inside))
    return _join_carry(found, carry, keys).withColumn(out, F.coalesce(out, "_carry")).drop("_carry", "_value", _RANGE)


def with_running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], span: int = SPAN) -> DataFrame:
    """df with running sums, up to and including each row."""
    ranged = _ranged(df.withColumns({f"_v_{n}": c for n, c in sums.items()}), order, span)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = ranged.groupBy(*keys, _RANGE).agg(F.struct(*(F.sum(f"_v_{n}").alias(n) for n in sums)).alias("_sums"))
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(*keys, _RANGE, F.struct(*(F.sum(f"_sums.{n}").over(before).alias(n) for n in sums)).alias("_carry"))
    found = ranged.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in sums})
    done = _join_carry(found, carry, keys)
    return done.withColumns({n: F.when(F.col(f"_carry.{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"_carry.{n}")).otherwise(F.col(n) + F.col(f"_carry.{n}")) for n in sums}).drop("_carry", _RANGE, *(f"_v_{n}" for n in sums))


def with_greatest_before(df: DataFrame, keys: list[str], order: str, value: str, out: str, span: int = SPAN) -> DataFrame:
    """df with the greatest value of the rows before each in the order of its key; null for a key's first row."""
    ranged = _ranged(df, order, span)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    most = ranged.groupBy(*keys, _RANGE).agg(F.max(value).alias("_most"))
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = most.select(*keys, _RANGE, F.max("_most").over(before).alias("_carry"))
    return _join_carry(ranged.withColumn(out, F.max(value).over(inside)), carry, keys).withColumn(out, F.greatest(out, "_carry")).drop("_carry", _RANGE)


def with_number(df: DataFrame, keys: list[str], order: str, out: str, span: int = SPAN) -> DataFrame:
    """df with its place in the order of its key, from 1."""
    return with_running(df, keys, order, {out: F.lit(1).cast("long")}, span)


def with_interval(rows: DataFrame, keys: list[str], number: str, intervals: DataFrame, out: str, span: int = SPAN) -> DataFrame:
    """rows with the struct of the interval that holds their number; null if there is none.

    intervals: keys, start, end (both included) and more columns; those of a key don't overlap. Intervals are cut at the ranges
    of numbers, put among the rows of their range, and carried on in order: a sort, where a join on the range would compare each
    row with every interval of it.
    """
    others = [c for c in intervals.columns if c not in keys]
    cut = intervals.withColumn(_RANGE, F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(F.col("end") / span))))
    cut = cut.select(*keys, _RANGE, F.greatest(F.col("start"), F.col(_RANGE) * span).alias("_at"), F.lit(0).alias("_kind"), F.struct(*others).alias("_interval"))
    own = rows.select(*keys, F.floor(F.col(number) / span).alias(_RANGE), F.col(number).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    order = Window.partitionBy(*keys, _RANGE).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = cut.unionByName(own, allowMissingColumns=True).withColumn("_last", F.last("_interval", ignorenulls=True).over(order)).where("_kind = 1")
    return found.select("_row.*", F.when(F.col("_last.end") >= F.col("_at"), F.col("_last")).alias(out))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = 100, span: int = SPAN) -> DataFrame:
    """df with the mean of the last `width` values, the row's own included: a difference of two running sums."""
    counted = with_running(df, keys, order, {"_n": F.lit(1).cast("long"), "_s": F.col(value).cast("decimal(38,6)")}, span)
    earlier = counted.select(*(F.col(k).alias(f"_e_{k}") for k in keys), (F.col("_n") + width).alias("_e_n"), F.col("_s").alias("_e_s"))
    met = F.col("_n") == F.col("_e_n")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    joined = counted.join(earlier, met, "left")
    mean = (F.col("_s") - F.coalesce("_e_s", F.lit(0))).cast("double") / F.least("_n", F.lit(width))
    return joined.withColumn(out, mean).drop("_n", "_s", "_e_n", "_e_s", *(f"_e_{k}" for k in keys))


def exponential_average(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = 100) -> DataFrame:
    """One row a key: ((average * (width - 1)) + x) / width, folded over the key's values in order; it starts at the first.

    The fold is a sum of values with weights that depend on their place alone, so it's a partial aggregate: each range of
    the order is folded to one number and its length, and the ranges, few, are folded in turn.
    """
    q = (width - 1) / width
    numbered = with_number(df.where(F.col(value).isNotNull()), keys, order, "_n")
    n = numbered.groupBy(*keys).agg(F.max("_n").alias("_all")).select(*(F.col(k).alias(f"_t_{k}") for k in keys), "_all")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    weight = F.pow(F.lit(q), (F.col("_all") - F.col("_n")).cast("double")) * F.when(F.col("_n") == 1, 1.0).otherwise(1 / width)
    return numbered.join(n, met).groupBy(*keys).agg(F.sum(F.col(value) * weight).alias(out))


def previous_rate(df: DataFrame, keys: list[str], order: str, ts: str, amount: Column, out: str) -> DataFrame:
    """df with amount / seconds since the row before; null for the first row and where no time has passed."""
    found = with_previous(df, keys, order, [ts], "_before")
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"_before.{ts}").cast("timestamp"))) / 1e6
    return found.withColumn(out, F.when(seconds > 0, amount / seconds)).drop("_before")


def with_idle(df: DataFrame, keys: list[str], order: str, ts: str, seconds: float, span: int = SPAN) -> DataFrame:
    """df with idle_seconds since the row before, and heartbeats: how many fall due in that time, one each `seconds`."""
    found = with_previous(df, keys, order, [ts], "_before", span)
    idle = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"_before.{ts}").cast("timestamp"))) / 1e6
    return found.withColumn("idle_seconds", idle).withColumn("heartbeats", F.coalesce(F.floor(F.col("idle_seconds") / seconds), F.lit(0))).drop("_before")
