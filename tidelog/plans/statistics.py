"""Queries of statistics: events, rows, tables, errors, histograms, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.measures import ERROR_MARKS, LOB_BUCKETS, SIZE_BUCKETS, bucket_sql
from tidelog.operators import feed, ordered, stats
from tidelog.plans.registry import query, read


def failed():
    return F.col("event_type") == "error"


def size():
    return F.octet_length("props")



def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query("""
SELECT event_type, count(*) AS events, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes,
       round(avg(value), 4) AS avg_value, min(ts) AS first_seen, max(ts) AS last_seen
FROM events GROUP BY event_type""")
def event_type_stats(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("events"), F.sum(size()).cast("long").alias("bytes"), F.round(F.avg("value"), 4).alias("avg_value"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


@query("""
SELECT user_id, count(*) FILTER (event_type <> 'error') AS events, count(*) FILTER (event_type = 'error') AS errors,
       coalesce(sum(octet_length(encode(props))) FILTER (event_type <> 'error'), 0)::BIGINT AS bytes,
       round(sum(value) FILTER (event_type <> 'error'), 4) AS total_time, round(avg(value) FILTER (event_type <> 'error'), 4) AS avg_time,
       min(value) FILTER (event_type <> 'error') AS min_time, max(value) FILTER (event_type <> 'error') AS max_time,
       round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 4)::DOUBLE AS success_rate
FROM events GROUP BY user_id""")
def event_success_rate(spark, sf_dir):
    out = stats.events(read(spark, sf_dir, "events"), ["user_id"], size(), F.col("value"), failed())
    return _rounded(out, "total_time", "avg_time", "success_rate").drop("first_seen", "last_seen", "events_per_second", "bytes_per_second")


@query("""
SELECT event_type, round(CASE WHEN s >= 1 THEN n / s ELSE 0 END, 6) AS events_per_second, round(CASE WHEN s >= 1 THEN b / s ELSE 0 END, 6) AS bytes_per_second
FROM (SELECT event_type, count(*)::DOUBLE AS n, sum(octet_length(encode(props)))::DOUBLE AS b, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM events GROUP BY 1)""")
def event_rates(spark, sf_dir):
    out = stats.events(read(spark, sf_dir, "events"), ["event_type"], size(), F.col("value"), F.lit(False))
    return out.select("event_type", F.round("events_per_second", 6).alias("events_per_second"), F.round("bytes_per_second", 6).alias("bytes_per_second"))


@query("SELECT event_type, count(*) AS events, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM events GROUP BY 1")
def event_type_distribution(spark, sf_dir):
    return _rounded(stats.distribution(read(spark, sf_dir, "events"), "event_type"), "percent")


@query("SELECT event_type, count(*) AS events FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_event_types(spark, sf_dir):
    return stats.top(read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events")), "events", ["event_type"], 3)


@query("""
SELECT count(*) FILTER (event_type <> 'error') AS events, count(*) FILTER (event_type = 'error') AS errors, sum(octet_length(encode(props)))::BIGINT AS bytes,
       min(ts) AS first_seen, max(ts) AS last_seen, max(event_id) AS current_event_id, arg_max(user_id, event_id) AS current_user_id,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 4)::DOUBLE AS success_rate
FROM events""")
def progress_info(spark, sf_dir):
    return _rounded(stats.progress(read(spark, sf_dir, "events"), "event_id", size(), failed(), ["event_id", "user_id"]), "success_rate")


@query("""
SELECT user_id AS key, count(*) FILTER (event_type = 'signup') AS inserts, count(*) FILTER (event_type NOT IN ('signup', 'error')) AS updates,
       count(*) FILTER (event_type = 'error') AS deletes FROM events GROUP BY 1""")
def op_counts_by_table(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), feed.operation(F.col("event_type")).alias("op"))
    return stats.operations(rows, ["key"])


_TABLES = """
SELECT o_orderpriority, count(*) AS rows, sum(octet_length(encode(o_orderstatus)) + 8)::BIGINT AS bytes, round(avg(octet_length(encode(o_orderstatus)) + 8), 4) AS avg_row_size,
       round(sum(o_totalprice), 2) AS time, count(*) FILTER (o_orderstatus = 'P') AS errors, round(100.0 * count(*) FILTER (o_orderstatus = 'P') / count(*), 4)::DOUBLE AS error_rate
FROM orders GROUP BY 1"""


def _order_tables(spark, sf_dir):
    out = stats.tables(read(spark, sf_dir, "orders"), ["o_orderpriority"], F.octet_length("o_orderstatus") + 8, F.col("o_totalprice"), F.col("o_orderstatus") == "P")
    return _rounded(out, "avg_row_size", "error_rate").withColumn("time", F.round("time", 2))


@query(_TABLES)
def table_metrics(spark, sf_dir):
    return _order_tables(spark, sf_dir)


@query(_TABLES + " ORDER BY 2 DESC, 1 LIMIT 3")
def top_tables(spark, sf_dir):
    return stats.top(_order_tables(spark, sf_dir), "rows", ["o_orderpriority"], 3)


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS rows, sum(octet_length(encode(o_orderpriority)))::BIGINT AS bytes, grouping(o_orderstatus, o_orderpriority)::INT AS level
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def table_totals(spark, sf_dir):
    return stats.tables_with_totals(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", F.octet_length("o_orderpriority"))


@query(f"SELECT {bucket_sql('octet_length(encode(text))', SIZE_BUCKETS)} AS bucket, count(*) AS rows FROM documents GROUP BY 1")
def size_histogram(spark, sf_dir):
    return stats.size_histogram(read(spark, sf_dir, "documents"), F.octet_length("text"))


@query("SELECT count(*) AS rows, round(avg(octet_length(encode(text))), 4) AS avg_size, min(octet_length(encode(text)))::BIGINT AS min_size, max(octet_length(encode(text)))::BIGINT AS max_size FROM documents")
def row_sizes(spark, sf_dir):
    return _rounded(stats.sizes(read(spark, sf_dir, "documents"), F.octet_length("text")), "avg_size")


@query(f"SELECT {bucket_sql('octet_length(encode(html))', LOB_BUCKETS)} AS bucket, count(*) AS rows, sum(octet_length(encode(html)))::BIGINT AS bytes FROM pages GROUP BY 1")
def lob_histogram(spark, sf_dir):
    return stats.lob_histogram(read(spark, sf_dir, "pages"), F.octet_length("html"))


def _with_nulls(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"), F.when(F.col("value") >= 10, F.col("value")).alias("value"), F.nullif("props", F.lit('{"k": 1}')).alias("props"))


_NULLED = """nulled AS (SELECT event_id, nullif(event_type, 'click') AS event_type, CASE WHEN value >= 10 THEN value END AS value, nullif(props, '{"k": 1}') AS props FROM events)"""


@query(f"""
WITH {_NULLED}
SELECT column_name, rows, nulls, round(100.0 * nulls / rows, 4)::DOUBLE AS percent FROM (
  SELECT 'event_type' AS column_name, count(*) AS rows, count(*) - count(event_type) AS nulls FROM nulled UNION ALL
  SELECT 'value', count(*), count(*) - count(value) FROM nulled UNION ALL SELECT 'props', count(*), count(*) - count(props) FROM nulled)""")
def null_stats(spark, sf_dir):
    return _rounded(stats.nulls(_with_nulls(spark, sf_dir), ["event_type", "value", "props"]), "percent")


@query(f"WITH {_NULLED} SELECT 3.0::DOUBLE AS avg_columns, 3::INT AS max_columns, 3 * count(*) AS cells, 3 * count(*) - count(event_type) - count(value) - count(props) AS null_cells FROM nulled")
def column_stats(spark, sf_dir):
    return stats.cells(_with_nulls(spark, sf_dir).select(feed.image([F.col("event_type"), F.col("value"), F.col("props")]).alias("after")))


@query(f"WITH {_NULLED} SELECT 'bigint' AS type, count(event_id) AS cells FROM nulled UNION ALL SELECT 'string', count(event_type) + count(props) FROM nulled UNION ALL SELECT 'double', count(value) FROM nulled")
def cell_types(spark, sf_dir):
    return stats.types(_with_nulls(spark, sf_dir), ["event_id", "event_type", "value", "props"])


#: Errors of the log get a message by their number, so that every class occurs.
_MESSAGE = "CASE event_id % 6 WHEN 0 THEN 'io: broken pipe' WHEN 1 THEN 'cannot parse row' WHEN 2 THEN 'decode failed' WHEN 3 THEN 'out of memory' WHEN 4 THEN 'timeout' ELSE 'other' END"


@query(f"""
SELECT category, user_id, count(*) AS errors, count(*) FILTER (event_id % 2 = 0) AS recovered, count(*) FILTER (event_id % 2 <> 0) AS fatal FROM (
  SELECT *, CASE {' '.join(f"WHEN contains(m, '{mark}') THEN '{name}'" for mark, name in ERROR_MARKS)} ELSE 'General Error' END AS category FROM (
    SELECT *, {_MESSAGE} AS m FROM events WHERE event_type = 'error')) GROUP BY 1, 2""")
def error_stats(spark, sf_dir):
    log = read(spark, sf_dir, "events").where(failed()).withColumn("message", F.expr(_MESSAGE))
    return stats.errors(log, "message", ["user_id"], F.col("event_id") % 2 == 0)


@query("""
SELECT user_id, round(rows / seconds, 6) AS throughput, round(time / rows, 6) AS avg_parse_time, round(hits::DOUBLE / (hits + misses), 6) AS cache_hit_ratio,
       round(errors::DOUBLE / (rows + errors), 6) AS error_rate, CASE WHEN errors = 0 THEN 0.0 ELSE round(recovered::DOUBLE / errors, 6) END::DOUBLE AS recovery_rate
FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') AS rows, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, sum(value) FILTER (event_type <> 'error') AS time,
        count(*) FILTER (event_id % 3 > 0) AS hits, count(*) FILTER (event_id % 3 = 0) AS misses, count(*) FILTER (event_type = 'error') AS errors,
        count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS recovered FROM events GROUP BY 1)""")
def derived_metrics(spark, sf_dir):
    one = read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(~failed()).alias("rows"), stats.seconds_between(F.min("ts"), F.max("ts")).alias("seconds"), F.sum(F.when(~failed(), F.col("value"))).alias("time"),
        F.count_if(F.col("event_id") % 3 > 0).alias("hits"), F.count_if(F.col("event_id") % 3 == 0).alias("misses"), F.count_if(failed()).alias("errors"),
        F.count_if(failed() & (F.col("event_id") % 2 == 0)).alias("recovered"),
    )
    names = ("throughput", "avg_parse_time", "cache_hit_ratio", "error_rate", "recovery_rate")
    return stats.derived(one).select("user_id", *(F.round(n, 6).alias(n) for n in names))


@query("SELECT 'events: ' || count(*) || chr(10) || 'errors: ' || count(*) FILTER (event_type = 'error') || chr(10) || 'bytes: ' || sum(octet_length(encode(props))) AS report FROM events")
def summary_report(spark, sf_dir):
    one = read(spark, sf_dir, "events").agg(F.count("*").alias("events"), F.count_if(failed()).alias("errors"), F.sum(size()).alias("bytes"))
    return stats.report(one, ["events", "errors", "bytes"])


@query("""
SELECT event_id, user_id, round(avg(CAST(value AS DECIMAL(38, 6))) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6)::DOUBLE AS moving FROM events""")
def moving_average(spark, sf_dir):
    out = ordered.moving_average(read(spark, sf_dir, "events"), ["user_id"], "event_id", "value", "moving", 10, span=1 << 12)
    return out.select("event_id", "user_id", F.round("moving", 6).alias("moving"))


@query("""
WITH RECURSIVE n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM events),
r AS (SELECT user_id, k, m, value::DOUBLE AS a FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.k, n.m, (r.a * 99 + n.value) / 100 FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
SELECT user_id, round(a, 4) AS smoothed FROM r WHERE k = m""")
def exponential_average(spark, sf_dir):
    return _rounded(ordered.exponential_average(read(spark, sf_dir, "events"), ["user_id"], "event_id", "value", "smoothed"), "smoothed")


@query("""
SELECT event_id, round(CASE WHEN s > 0 THEN 1 / s END, 4) AS rows_per_second, round(CASE WHEN s > 0 THEN b / s END, 4) AS bytes_per_second
FROM (SELECT event_id, octet_length(encode(props)) AS b, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY event_id))) / 1e6 AS s FROM events)""")
def instant_rate(spark, sf_dir):
    events = ordered.with_previous(read(spark, sf_dir, "events"), [], "event_id", ["ts"], "before", span=1 << 12)
    s = stats.seconds_between(F.col("before.ts"), F.col("ts"))
    return events.select("event_id", F.round(F.when(s > 0, 1 / s), 4).alias("rows_per_second"), F.round(F.when(s > 0, size() / s), 4).alias("bytes_per_second"))


@query("""
SELECT event_id, round(avg(octet_length(encode(props))) OVER (ORDER BY event_id), 6) AS avg_size, count(*) OVER (ORDER BY event_id) AS rows FROM events""")
def running_average(spark, sf_dir):
    out = ordered.with_running(read(spark, sf_dir, "events"), [], "event_id", {"bytes": size().cast("long"), "rows": F.lit(1).cast("long")}, span=1 << 12)
    return out.select("event_id", F.round(F.col("bytes") / F.col("rows"), 6).alias("avg_size"), "rows")


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, sum(octet_length(encode(props)))::BIGINT AS bytes FROM events GROUP BY 1, 2""")
def windowed_rates(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(size()).cast("long").alias("bytes")).select(F.col("w.start").alias("window_start"), "event_type", "events", "bytes")


@query("""
SELECT window_start + INTERVAL 1 HOUR AS window_end, sum(n)::BIGINT AS events FROM (
  SELECT time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL (30 * k) MINUTE - INTERVAL 30 MINUTE AS window_start, 1 AS n FROM events, range(0, 2) AS r(k)) GROUP BY window_start""")
def sliding_rates(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("events")).select(F.col("w.end").alias("window_end"), "events")


@query("""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_activity(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS rows
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def lineitem_stats(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("rows"))
