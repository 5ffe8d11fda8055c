"""Queries of transaction-id sets; a user is a source, and an event's number a transaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import gtid
from tidelog.plans.registry import query, read


def _of(spark, sf_dir, kinds=None, divisor=None):
    """Event numbers are spread over a few sources so that neighbours meet."""
    events = read(spark, sf_dir, "events")
    events = events.where(F.col("event_type").isin(*kinds)) if kinds else events
    events = events.where(F.col("event_id") % divisor != 0) if divisor else events
    return gtid.singles(events, F.col("event_id") % 3, F.floor(F.col("event_id") / 3))


def _sql(where: str) -> str:
    return f"(SELECT event_id % 3 AS source, event_id // 3 AS n FROM events WHERE {where})"


def _islands(ids: str) -> str:
    return f"(SELECT source, min(n) AS \"start\", max(n) AS \"end\" FROM (SELECT source, n, n - row_number() OVER (PARTITION BY source ORDER BY n) AS g FROM (SELECT DISTINCT source, n FROM {ids})) GROUP BY source, g)"


_A, _B = "event_type IN ('click', 'view')", "event_type IN ('view', 'purchase', 'signup')"


@query(f"SELECT * FROM {_islands(_sql(_A))}")
def gtid_islands(spark, sf_dir):
    return gtid.merge(_of(spark, sf_dir, ("click", "view")), span=1 << 8)


@query("""
WITH i AS (SELECT l_suppkey AS source, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT source, min(s) AS "start", max(e) AS "end" FROM g GROUP BY source, k""")
def gtid_interval_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return gtid.merge(rows, span=1 << 10)


@query(f"""
SELECT source, source || ':' || string_agg(CASE WHEN "start" = "end" THEN "start"::VARCHAR ELSE "start" || '-' || "end" END, ':' ORDER BY "start") AS gtid_set
FROM {_islands(_sql(_A))} GROUP BY source""")
def gtid_set_text(spark, sf_dir):
    return gtid.set_text(_of(spark, sf_dir, ("click", "view")))


@query(f"SELECT source::VARCHAR AS source, \"start\", \"end\" FROM {_islands(_sql(_A))}")
def gtid_text_round_trip(spark, sf_dir):
    return gtid.merge(gtid.parse(gtid.set_text(_of(spark, sf_dir, ("click", "view")))))


@query(f"SELECT source, sum(\"end\" - \"start\" + 1)::BIGINT AS transactions, count(*) AS intervals, round(sum(\"end\" - \"start\" + 1)::DOUBLE / count(*), 6) AS ratio FROM {_islands(_sql(_A))} GROUP BY 1")
def gtid_count(spark, sf_dir):
    return gtid.count(_of(spark, sf_dir, ("click", "view"))).withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT count(DISTINCT source) AS servers, sum(\"end\" - \"start\" + 1)::BIGINT AS transactions, count(*) AS intervals FROM {_islands(_sql(_A))}")
def gtid_compression(spark, sf_dir):
    return gtid.count(_of(spark, sf_dir, ("click", "view"))).agg(F.count("*").alias("servers"), F.sum("transactions").alias("transactions"), F.sum("intervals").alias("intervals"))


_TESTED = "SELECT event_id, event_id % 3 AS source, event_id // 3 AS n FROM events WHERE event_type <> 'error'"


def _tested(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", (F.col("event_id") % 3).alias("source"), F.floor(F.col("event_id") / 3).alias("n"))


@query(f"SELECT event_id FROM ({_TESTED}) t WHERE EXISTS (SELECT 1 FROM {_sql(_A)} a WHERE a.source = t.source AND a.n = t.n)")
def gtid_contains(spark, sf_dir):
    return gtid.contains(_tested(spark, sf_dir), _of(spark, sf_dir, ("click", "view")), "source", "n").select("event_id")


@query(f"SELECT event_id FROM ({_TESTED}) t WHERE NOT EXISTS (SELECT 1 FROM {_sql(_A)} a WHERE a.source = t.source AND a.n = t.n)")
def gtid_missing(spark, sf_dir):
    return gtid.contains(_tested(spark, sf_dir), _of(spark, sf_dir, ("click", "view")), "source", "n", covered=False).select("event_id")


def _both(spark, sf_dir):
    return _of(spark, sf_dir, ("click", "view")), _of(spark, sf_dir, ("view", "purchase", "signup"))


@query(f"SELECT * FROM {_islands(f'(SELECT * FROM {_sql(_A)} UNION SELECT * FROM {_sql(_B)})')}")
def gtid_union(spark, sf_dir):
    return gtid.union(*_both(spark, sf_dir))


@query(f"SELECT * FROM {_islands(f'(SELECT * FROM {_sql(_A)} INTERSECT SELECT * FROM {_sql(_B)})')}")
def gtid_intersect(spark, sf_dir):
    return gtid.intersect(*_both(spark, sf_dir))


@query(f"SELECT * FROM {_islands(f'(SELECT * FROM {_sql(_A)} EXCEPT SELECT * FROM {_sql(_B)})')}")
def gtid_except(spark, sf_dir):
    return gtid.difference(*_both(spark, sf_dir))
