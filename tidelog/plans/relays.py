"""Queries of relay records, segments, routing and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import catalog, feed, relay
from tidelog.plans.registry import query, read

SPAN = 1 << 12


def records(spark, sf_dir):
    return relay.records(feed.from_events(read(spark, sf_dir, "events")), "default", "events")


_IMAGE = """'["' || event_type || '","' || value::DECIMAL(18, 4)::VARCHAR || '",' || to_json(props)::VARCHAR || ']'"""


@query(f"""
SELECT 'MYSQL' AS src_type, event_id AS event_log_pos, 'default' AS database_name, 'events' AS table_name, user_id AS key,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS command,
       '{{"before":' || coalesce(lag({_IMAGE}) OVER (PARTITION BY user_id ORDER BY event_id), 'null') || ',"after":' || {_IMAGE} || '}}' AS payload FROM events""")
def relay_records(spark, sf_dir):
    return records(spark, sf_dir).drop("log_size", "crc")


@query("SELECT true AS crc_ok, count(*) AS records FROM events")
def crc32_check(spark, sf_dir):
    return relay.verify(records(spark, sf_dir)).groupBy("crc_ok").agg(F.count("*").alias("records"))


def _entries(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("table_name"), F.octet_length("o_orderpriority").cast("long").alias("log_size"))
    return relay.numbered(orders, ["table_name"], "o_orderkey", span=SPAN)


_NUMBERED = "SELECT o_orderkey, o_orderstatus AS table_name, octet_length(encode(o_orderpriority))::BIGINT AS log_size, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS index FROM orders"
_SEGMENTS = f"SELECT table_name, (index - 1) // 100 + 1 AS segment_id, min(index) AS first_index, max(index) AS last_index, count(*) AS entries, sum(log_size)::BIGINT AS bytes, count(*) >= 100 AS \"full\" FROM ({_NUMBERED}) GROUP BY 1, 2"


@query(_SEGMENTS)
def relay_segments(spark, sf_dir):
    return relay.segment_table(relay.segments_by_entries(_entries(spark, sf_dir)), ["table_name"])


@query(f"""
SELECT table_name, segment_id, count(*) AS entries, min(index) AS first_index FROM (
  SELECT *, coalesce(sum(log_size) OVER (PARTITION BY table_name ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 1000 + 1 AS segment_id FROM ({_NUMBERED})) GROUP BY 1, 2""")
def relay_segments_by_bytes(spark, sf_dir):
    cut = relay.segments_by_bytes(_entries(spark, sf_dir), ["table_name"], "o_orderkey", 1000, span=SPAN)
    return cut.groupBy("table_name", "segment_id").agg(F.count("*").alias("entries"), F.min("index").alias("first_index"))


@query(f"""
SELECT o_orderstatus AS table_name, o_orderkey % 5000 AS index, segment_id, first_index, last_index FROM orders o
JOIN ({_SEGMENTS}) s ON s.table_name = o.o_orderstatus AND o_orderkey % 5000 BETWEEN first_index AND last_index""")
def segment_lookup(spark, sf_dir):
    segments = relay.segment_table(relay.segments_by_entries(_entries(spark, sf_dir)), ["table_name"])
    wanted = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("table_name"), (F.col("o_orderkey") % 5000).alias("index"))
    return relay.lookup(wanted, segments, ["table_name"]).select("table_name", "index", "segment_id", "first_index", "last_index")


@query(f"SELECT table_name, index % 1024 AS slot, max(index) AS index, arg_max(o_orderkey, index) AS o_orderkey FROM ({_NUMBERED}) GROUP BY 1, 2")
def ring_buffer_latest(spark, sf_dir):
    return relay.ring(_entries(spark, sf_dir), ["table_name"]).select("table_name", "slot", "index", "o_orderkey")


@query("""
SELECT key, event_id, event_type FROM (SELECT user_id AS key, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""")
def apply_changes_latest(spark, sf_dir):
    rows = feed.from_events(read(spark, sf_dir, "events"))
    return relay.apply(rows, ["key"], "event_id").select("key", "event_id", F.get("after", F.lit(0)).alias("event_type"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1""")
def latest_image_per_key(spark, sf_dir):
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", order.alias("at"), F.lit("UPDATE").alias("op"))
    return relay.apply(rows, ["l_orderkey", "l_linenumber"], "at").drop("at", "op")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10")
def newest_snapshots(spark, sf_dir):
    return relay.newest(read(spark, sf_dir, "events"), ["user_id"], [F.desc("event_id")], 10).select("user_id", "event_id")


@query(f"SELECT table_name, index FROM (SELECT *, max(segment_id) OVER (PARTITION BY table_name) AS m FROM (SELECT *, (index - 1) // 100 + 1 AS segment_id FROM ({_NUMBERED}))) WHERE segment_id > m - 2")
def retained_segments(spark, sf_dir):
    return relay.retain(relay.segments_by_entries(_entries(spark, sf_dir)), ["table_name"], 2).select("table_name", "index")


@query("""
WITH rules(task, databases, tables, target) AS (VALUES ('t1', ['AMERICA', 'ASIA'], ['CHINA', 'BRAZIL', 'JAPAN'], 'sales'), ('t2', ['EUROPE'], ['FRANCE', 'GERMANY'], 'eu'), ('t3', ['ASIA'], ['CHINA'], 'cn'))
SELECT s_suppkey, task, target FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN rules ON list_contains(databases, r_name) AND list_contains(tables, n_name)""")
def routing_rules(spark, sf_dir):
    rules = spark.createDataFrame(
        [("t1", ["AMERICA", "ASIA"], ["CHINA", "BRAZIL", "JAPAN"], "sales"), ("t2", ["EUROPE"], ["FRANCE", "GERMANY"], "eu"), ("t3", ["ASIA"], ["CHINA"], "cn")],
        "task string, databases array<string>, tables array<string>, target string",
    )
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalog.route(rows, rules, "r_name", "n_name").select("s_suppkey", "task", "target")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def catalog_lookup(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    regions = read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return catalog.lookup(catalog.lookup(read(spark, sf_dir, "supplier"), nations, ["s_nationkey"]), regions, ["n_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("""
SELECT k, arg_max(name, seq) AS name, max(seq) AS seq FROM (SELECT c_custkey AS k, c_name AS name, 1 AS seq FROM customer UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier) GROUP BY 1""")
def catalog_upsert(spark, sf_dir):
    current = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(1).alias("seq"))
    return catalog.upsert(current, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit(2).alias("seq")), ["k"], "seq")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_suppkey % 7 = 0)")
def non_empty_schemas(spark, sf_dir):
    tables = read(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("database_name"))
    schemas = read(spark, sf_dir, "region").withColumn("database_name", F.col("r_regionkey"))
    return catalog.without_empty(schemas, tables).select("r_regionkey", "r_name")


@query("""SELECT 'default' AS database_name, 'nation' AS table_name, 'INSERT' AS op, n_nationkey::VARCHAR AS row_key, n_nationkey || '|' || n_name || '|' || n_regionkey AS image FROM nation""")
def snapshot_to_inserts(spark, sf_dir):
    out = feed.from_snapshot(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"], "nation")
    return out.select("database_name", "table_name", "op", "row_key", F.array_join("after", "|").alias("image"))


@query("SELECT event_id, event_id % 4 AS source FROM events WHERE (event_id * 7919) % 100 < 10")
def sampled_rows(spark, sf_dir):
    return read(spark, sf_dir, "events").where((F.col("event_id") * 7919) % 100 < 10).select("event_id", (F.col("event_id") % 4).alias("source"))
