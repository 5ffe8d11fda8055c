"""Queries of as-of joins over the log: a signup is a table map, an error ends a statement, a purchase begins a transaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import asof, ordered
from tidelog.plans.registry import query, read

SPAN = 1 << 12


def is_kind(name: str):
    return F.col("event_type") == name


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS table_map FROM events""")
def asof_table_map(spark, sf_dir):
    return asof.with_table_map(read(spark, sf_dir, "events"), ["user_id"], "event_id", is_kind("signup"), None, F.col("event_id"), span=SPAN).select("event_id", "user_id", "table_map")


@query("""
WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS statement FROM events)
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, statement ORDER BY event_id) AS table_map FROM s""")
def asof_table_map_cleared(spark, sf_dir):
    return asof.with_table_map(read(spark, sf_dir, "events"), ["user_id"], "event_id", is_kind("signup"), is_kind("error"), F.col("event_id"), span=SPAN).select("event_id", "user_id", "table_map")


@query("""
SELECT event_id, CASE WHEN n > 0 THEN 'u' || user_id || ':' || n END AS gtid FROM (
  SELECT event_id, user_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)""")
def gtid_stamp(spark, sf_dir):
    log = asof.with_transaction_number(read(spark, sf_dir, "events"), ["user_id"], "event_id", is_kind("purchase"), span=SPAN)
    gtid = F.when(is_kind("purchase"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), F.col("txn").cast("string")))
    return asof.with_transaction(log, ["user_id"], "event_id", gtid, span=SPAN).select("event_id", "gtid")


@query("""
SELECT user_id, txn, min(event_id) AS first_pos, max(event_id) AS last_pos, count(*) AS events FROM (
  SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS txn FROM events) GROUP BY 1, 2""")
def txn_spans(spark, sf_dir):
    return asof.transaction_spans(read(spark, sf_dir, "events"), ["user_id"], "event_id", is_kind("purchase"), span=SPAN)


_VERSIONS = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events WHERE event_type = 'signup'"


def _versions(spark, sf_dir):
    return asof.table_versions(read(spark, sf_dir, "events").where(is_kind("signup")), ["user_id"], "event_id", span=SPAN).select("event_id", "user_id", "version")


@query(_VERSIONS)
def table_versions(spark, sf_dir):
    return _versions(spark, sf_dir)


@query(f"""
WITH v AS (SELECT user_id, max(version) AS current_version FROM ({_VERSIONS}) GROUP BY 1), e AS (SELECT DISTINCT user_id * 2 AS user_id, user_id % 20 AS expected_version FROM events)
SELECT e.user_id, expected_version, current_version, coalesce(current_version <> expected_version, true) AS changed FROM e LEFT JOIN v USING (user_id)""")
def table_changed(spark, sf_dir):
    expected = read(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("user_id"), (F.col("user_id") % 20).alias("expected_version")).distinct()
    return asof.changed_tables(expected, _versions(spark, sf_dir), ["user_id"])


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS place, lag(event_type) OVER (ORDER BY event_id) AS before FROM events")
def log_places(spark, sf_dir):
    rows = ordered.with_number(read(spark, sf_dir, "events"), [], "event_id", "place", span=SPAN)
    return ordered.with_previous(rows, [], "event_id", ["event_type"], "b", span=SPAN).select("event_id", "user_id", "place", F.col("b.event_type").alias("before"))


@query("""
SELECT p.p_partkey AS table_id, len(p.types) AS n, CASE WHEN s.names IS NOT NULL THEN array_to_string(list_transform(list_zip(s.names, p.types), lambda x: x[1] || ' ' || x[2]), ',') END AS columns
FROM (SELECT p_partkey, string_split(p_type, ' ') AS types, p_size FROM part) p
LEFT JOIN (SELECT s_suppkey, string_split(s_name || '#a#b', '#') AS names FROM supplier) s ON s.s_suppkey = p.p_size AND len(s.names) = len(p.types)""")
def named_columns(spark, sf_dir):
    maps = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.col("p_size").cast("long").alias("table_name"), F.split("p_type", " ").alias("types"))
    definitions = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("table_name"), F.split(F.concat("s_name", F.lit("#a#b")), "#").alias("names"))
    out = asof.named_columns(maps, definitions)
    return out.select("table_id", F.size("types").cast("long").alias("n"), F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ",").alias("columns"))


@query("""
SELECT o_orderkey, string_agg(c || ':' || CASE WHEN (o_orderkey + i) % 4 = 0 THEN 45 ELSE 33 END, ',' ORDER BY i) AS charsets
FROM (SELECT o_orderkey, unnest(range(0, 3)) AS i, unnest([o_orderstatus, o_orderpriority, 'x']) AS c FROM orders) GROUP BY 1""")
def column_charsets(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    at = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (F.col("o_orderkey") + i) % 4 == 0)
    exceptions = F.map_from_arrays(at, F.transform(at, lambda i: F.lit(45)))
    columns = asof.with_charsets(F.array("o_orderstatus", "o_orderpriority", F.lit("x")), 33, exceptions)
    return orders.select("o_orderkey", F.array_join(F.transform(columns, lambda c: F.concat_ws(":", c["column"], c["charset"].cast("string"))), ",").alias("charsets"))
