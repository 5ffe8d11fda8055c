"""Statistics of a log's events, rows, tables and errors. All are partial aggregates of one pass over their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.measures import LOB_BUCKETS, SIZE_BUCKETS, bucket, error_category, share


def seconds_between(first: Column, last: Column) -> Column:
    return (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6


def events(log: DataFrame, by: list[str], size: Column, duration: Column, failed: Column, ts: str = "ts") -> DataFrame:
    """Count, bytes, durations, errors, first and last seen, success rate and rates a second, of each kind of event.

    An event that failed counts as an error only. Rates are 0 while less than a second has passed.
    """
    ok = ~failed
    out = log.groupBy(*by).agg(
        F.count_if(ok).alias("events"), F.count_if(failed).alias("errors"), F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).cast("long").alias("bytes"),
        F.sum(F.when(ok, duration)).alias("total_time"), F.avg(F.when(ok, duration)).alias("avg_time"), F.min(F.when(ok, duration)).alias("min_time"),
        F.max(F.when(ok, duration)).alias("max_time"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
    )
    span = seconds_between(F.col("first_seen"), F.col("last_seen"))
    per_second = lambda c: F.when(span >= 1, F.col(c) / span).otherwise(0.0)
    return out.withColumn("success_rate", share(F.col("events"), F.col("events") + F.col("errors"), 100.0)).withColumn("events_per_second", per_second("events")).withColumn("bytes_per_second", per_second("bytes"))


def distribution(log: DataFrame, kind: str) -> DataFrame:
    """Each kind's number and its share of all, in percent; the total is an aggregate of the kinds, joined as one row."""
    counted = log.groupBy(kind).agg(F.count("*").alias("events"))
    return counted.join(F.broadcast(counted.agg(F.sum("events").alias("total")))).withColumn("percent", share(F.col("events"), F.col("total"))).drop("total")


def top(counted: DataFrame, measure: str, tie: list[str], k: int = 10) -> DataFrame:
    """The k rows with the largest measure; ties go to the smaller names."""
    return counted.orderBy(F.desc(measure), *tie).limit(k)


def progress(log: DataFrame, order: str, size: Column, failed: Column, position: list[str], ts: str = "ts") -> DataFrame:
    """One row: events, errors, bytes, span in seconds, and where the log stands."""
    out = log.agg(
        F.count_if(~failed).alias("events"), F.count_if(failed).alias("errors"), F.sum(size).cast("long").alias("bytes"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        *(F.max_by(c, order).alias(f"current_{c}") for c in position),
    )
    return out.withColumn("seconds", seconds_between(F.col("first_seen"), F.col("last_seen"))).withColumn("success_rate", share(F.col("events"), F.col("events") + F.col("errors"), 100.0))


def operations(feed: DataFrame, by: list[str]) -> DataFrame:
    return feed.groupBy(*by).agg(F.count_if(F.col("op") == "INSERT").alias("inserts"), F.count_if(F.col("op") == "UPDATE").alias("updates"), F.count_if(F.col("op") == "DELETE").alias("deletes"))


def tables(rows: DataFrame, by: list[str], size: Column, duration: Column, failed: Column) -> DataFrame:
    """Rows, bytes, mean row size, time, errors and error rate of each table."""
    out = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"), F.avg(size).alias("avg_row_size"), F.sum(duration).alias("time"), F.count_if(failed).alias("errors"))
    return out.withColumn("error_rate", share(F.col("errors"), F.col("rows")))


def tables_with_totals(rows: DataFrame, database: str, table: str, size: Column) -> DataFrame:
    """Rows and bytes of each table, of each database (table null) and of everything (both null)."""
    return rows.rollup(database, table).agg(F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"), F.grouping_id().cast("int").alias("level"))


def sizes(rows: DataFrame, size: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.avg(size).alias("avg_size"), F.min(size).cast("long").alias("min_size"), F.max(size).cast("long").alias("max_size"))


def size_histogram(rows: DataFrame, size: Column) -> DataFrame:
    return rows.groupBy(bucket(size, SIZE_BUCKETS).alias("bucket")).agg(F.count("*").alias("rows"))


def lob_histogram(rows: DataFrame, size: Column) -> DataFrame:
    return rows.groupBy(bucket(size, LOB_BUCKETS).alias("bucket")).agg(F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"))


def nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of each column, in one pass: column_name, rows, nulls, percent."""
    one = rows.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)))
    return one.select("rows", F.explode(pairs).alias("p")).select("p.column_name", "rows", "p.nulls").withColumn("percent", share(F.col("nulls"), F.col("rows")))


def cells(rows: DataFrame, image: str = "after") -> DataFrame:
    """Mean and largest number of columns, cells and null cells of images."""
    return rows.where(F.col(image).isNotNull()).agg(
        F.avg(F.size(image)).alias("avg_columns"), F.max(F.size(image)).alias("max_columns"), F.sum(F.size(image)).alias("cells"),
        F.sum(F.size(F.filter(image, lambda c: c.isNull()))).alias("null_cells"),
    )


def types(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null cells by the Spark type of their column."""
    kinds = dict(rows.dtypes)
    one = rows.agg(*(F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(kinds[c]).alias("type"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)))
    return one.select(F.explode(pairs).alias("p")).groupBy("p.type").agg(F.sum("p.n").alias("cells"))


def errors(log: DataFrame, message: str, by: list[str], recovered: Column) -> DataFrame:
    """Errors by class: their number, and recovered and fatal ones."""
    return log.withColumn("category", error_category(F.col(message))).groupBy("category", *by).agg(F.count("*").alias("errors"), F.count_if(recovered).alias("recovered"), F.count_if(~recovered).alias("fatal"))


def recoveries(log: DataFrame, recovered: Column, nanos: Column, skipped: Column, by: list[str]) -> DataFrame:
    """Recoveries that worked and that didn't, the mean time of those that did, and the rows that were passed over."""
    return log.groupBy(*by).agg(
        F.count_if(recovered).alias("successful_recoveries"), F.count_if(~recovered).alias("failed_recoveries"),
        F.coalesce(F.avg(F.when(recovered, nanos)), F.lit(0.0)).alias("avg_recovery_time"), F.coalesce(F.sum(F.when(recovered, skipped)), F.lit(0)).cast("long").alias("rows_skipped"),
    )


def pools(log: DataFrame, by: list[str], size: Column, nanos: Column, hit: Column) -> DataFrame:
    """Rows, bytes, mean parse time, rows a second of parse time, hits, misses and hit ratio of row buffers."""
    out = log.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"), F.sum(nanos).alias("time"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"),
    )
    return out.withColumns({
        "avg_parse_time": F.col("time") / F.col("rows"), "rows_per_second": F.when(F.col("time") > 0, F.col("rows") * 1e9 / F.col("time")).otherwise(0.0), "hit_ratio": F.col("hits") / F.col("rows"),
    })


def locks(log: DataFrame, by: list[str], reads: Column, waited: Column, ts: str = "ts") -> DataFrame:
    """Reads, writes, contended accesses, mean wait, read/write ratio (null without writes) and accesses a second."""
    out = log.groupBy(*by).agg(
        F.count_if(reads).alias("reads"), F.count_if(~reads).alias("writes"), F.count_if(waited > 0).alias("contended"), F.avg(waited).alias("avg_wait"), F.min(ts).alias("_a"), F.max(ts).alias("_z"),
    )
    span = seconds_between(F.col("_a"), F.col("_z"))
    return out.withColumns({
        "read_write_ratio": F.when(F.col("writes") > 0, F.col("reads") / F.col("writes")), "ops_per_second": F.when(span > 0, (F.col("reads") + F.col("writes")) / span).otherwise(0.0),
    }).drop("_a", "_z")


def interning(rows: DataFrame, text: str, least: int = 3) -> DataFrame:
    """One row: strings, those long enough to share, different ones among them, and the bytes that sharing saves."""
    counted = rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("n"))
    shared, size = F.length(text) >= least, F.octet_length(text)
    return counted.agg(
        F.sum("n").cast("long").alias("strings"), F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).cast("long").alias("interned"), F.count_if(shared).alias("pool_size"),
        F.coalesce(F.sum(F.when(shared, (F.col("n") - 1) * size)), F.lit(0)).cast("long").alias("bytes_saved"),
    )


def registrations(entries: DataFrame) -> DataFrame:
    """One row: decoders, types that have one, those with several, and decoders of one's own. entries: (type, name, is_custom)."""
    return entries.groupBy("type").agg(F.count("*").alias("n"), F.count_if("is_custom").alias("c")).agg(
        F.sum("n").cast("long").alias("decoders"), F.count("*").alias("types"), F.count_if(F.col("n") > 1).alias("conflicts"), F.sum("c").cast("long").alias("custom"),
    )


def derived(one: DataFrame) -> DataFrame:
    """Ratios of a row of totals (rows, seconds, time, hits, misses, errors, recovered): 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return one.withColumns({
        "throughput": ratio(F.col("rows"), F.col("seconds")), "avg_parse_time": ratio(F.col("time"), F.col("rows")), "cache_hit_ratio": ratio(F.col("hits"), F.col("hits") + F.col("misses")),
        "error_rate": ratio(F.col("errors"), F.col("rows") + F.col("errors")), "recovery_rate": ratio(F.col("recovered"), F.col("errors")),
    })


def sample(rows: DataFrame, key: str, rate: float) -> DataFrame:
    """Rows whose key's hash lies below the rate: the same rows on every run, and the same keys in every table."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(rate * (1 << 30)))


def report(one: DataFrame, columns: list[str]) -> DataFrame:
    """A row's columns as lines of text."""
    return one.select(F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns)).alias("report"))
