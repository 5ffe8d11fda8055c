"""Queries of changes: field differences, summaries, sparse updates, frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.measures import PERCENT_BUCKETS, bucket_sql
from tidelog.operators import changes, feed
from tidelog.plans.registry import query, read

_PAIRS = """
pairs AS (SELECT * FROM (
  SELECT event_id, user_id AS key, event_type AS a0, value::DECIMAL(18, 4)::VARCHAR AS a1, props AS a2, lag(event_id) OVER w AS prior,
         lag(event_type) OVER w AS b0, lag(value::DECIMAL(18, 4)::VARCHAR) OVER w AS b1, lag(props) OVER w AS b2
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE prior IS NOT NULL),
cells AS (SELECT event_id, key, 0 AS column_index, b0 AS b, a0 AS a FROM pairs UNION ALL SELECT event_id, key, 1, b1, a1 FROM pairs UNION ALL SELECT event_id, key, 2, b2, a2 FROM pairs),
sums AS (SELECT event_id, key, count(*) FILTER (a IS DISTINCT FROM b) AS changed, 3 AS total, 100.0::DOUBLE * count(*) FILTER (a IS DISTINCT FROM b) / 3 AS percent,
           sum(octet_length(encode(a)) + octet_length(encode(b)) + 48) AS image_bytes,
           coalesce(sum(octet_length(encode(a)) + octet_length(encode(b)) + 48) FILTER (a IS DISTINCT FROM b), 0) AS diff_bytes FROM cells GROUP BY 1, 2)"""


def _updates(spark, sf_dir):
    return changes.updates(feed.from_events(read(spark, sf_dir, "events")))


@query(f"""
WITH {_PAIRS} SELECT event_id, key, ['event_type', 'value', 'props'][column_index + 1] AS column_name, b AS before_value, a AS after_value,
  CASE WHEN b IS NULL THEN 'null_to_value' WHEN a IS NULL THEN 'value_to_null' ELSE 'value_to_value' END AS kind FROM cells WHERE a IS DISTINCT FROM b""")
def update_diff_fields(spark, sf_dir):
    out = changes.fields(_updates(spark, sf_dir))
    return out.select("event_id", "key", F.get(F.array(*(F.lit(n) for n in feed.FIELDS)), "column_index").alias("column_name"), "before_value", "after_value", "kind")


@query("""
WITH n AS (SELECT event_id, user_id, nullif(event_type, 'click') AS t, CASE WHEN value >= 10 THEN 'high' END AS v FROM events),
p AS (SELECT event_id, t, v, lag(event_id) OVER w AS prior, lag(t) OVER w AS bt, lag(v) OVER w AS bv FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT 0 AS column_index, bt AS b, t AS a FROM p WHERE prior IS NOT NULL UNION ALL SELECT 1, bv, v FROM p WHERE prior IS NOT NULL)
SELECT column_index, CASE WHEN b IS NULL THEN 'null_to_value' WHEN a IS NULL THEN 'value_to_null' ELSE 'value_to_value' END AS kind, count(*) AS changes
FROM c WHERE a IS DISTINCT FROM b GROUP BY 1, 2""")
def null_transitions(spark, sf_dir):
    from tidelog.operators.ordered import with_previous

    events = read(spark, sf_dir, "events")
    cells = events.select("event_id", F.col("user_id").alias("key"), feed.image([F.nullif("event_type", F.lit("click")), F.when(F.col("value") >= 10, "high")]).alias("after"))
    rows = with_previous(cells, ["key"], "event_id", ["after"]).select("event_id", "key", F.col("previous.after").alias("before"), "after")
    return changes.fields(changes.updates(rows)).groupBy("column_index", "kind").agg(F.count("*").alias("changes"))


@query(f"""
WITH {_PAIRS} SELECT event_id, key, changed::INT AS changed, total::INT AS total, round(percent, 4) AS percent, changed > 0 AND changed < total AS partial,
  round(100.0::DOUBLE * (total - changed) / total, 4) AS savings, image_bytes::BIGINT AS image_bytes, diff_bytes::BIGINT AS diff_bytes,
  round(100.0::DOUBLE * diff_bytes / image_bytes, 4) AS overhead_percent FROM sums""")
def update_diff_summary(spark, sf_dir):
    out = changes.analysis(_updates(spark, sf_dir))
    return out.select(
        "event_id", "key", "changed", "total", F.round("percent", 4).alias("percent"), changes.is_partial(F.col("changed"), F.col("total")).alias("partial"),
        F.round(changes.savings(F.col("changed"), F.col("total")), 4).alias("savings"), "image_bytes", "diff_bytes", F.round("overhead_percent", 4).alias("overhead_percent"),
    )


@query(f"""
WITH {_PAIRS} SELECT event_id, string_agg(column_index || '=' || a, ',' ORDER BY column_index) AS changed_values FROM cells WHERE a IS DISTINCT FROM b GROUP BY 1""")
def incremental_updates(spark, sf_dir):
    rows = _updates(spark, sf_dir).where(F.size("diff") > 0)
    new = changes.new_values(F.col("diff"))
    return rows.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(new)), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ",").alias("changed_values"))


@query(f"WITH {_PAIRS} SELECT event_id, changed::INT AS changed FROM sums WHERE changed > 0 AND percent < 40")
def sparse_updates(spark, sf_dir):
    return _updates(spark, sf_dir).where(changes.is_sparse(F.col("percent"), 40.0) & (F.col("changed") > 0)).select("event_id", "changed")


@query(f"WITH {_PAIRS} SELECT key, count(*) AS partial_updates FROM sums WHERE changed > 0 AND changed < total GROUP BY 1")
def partial_updates(spark, sf_dir):
    return _updates(spark, sf_dir).where(changes.is_partial(F.col("changed"), F.col("total"))).groupBy("key").agg(F.count("*").alias("partial_updates"))


@query(f"WITH {_PAIRS} SELECT event_id, b AS before_value, a AS after_value FROM cells WHERE column_index = 0 AND a IS DISTINCT FROM b")
def column_change_lookup(spark, sf_dir):
    rows = _updates(spark, sf_dir).where(changes.has_change(F.col("diff"), 0)).withColumn("c", changes.change_at(F.col("diff"), 0))
    return rows.select("event_id", F.col("c.before").alias("before_value"), F.col("c.after").alias("after_value"))


@query(f"WITH {_PAIRS} SELECT event_id, count(*) FILTER (a IS DISTINCT FROM b AND column_index IN (1, 2))::INT AS restricted, count(*) FILTER (a IS DISTINCT FROM b AND column_index <> 1)::INT AS without_value FROM cells GROUP BY 1")
def diff_subsets(spark, sf_dir):
    rows = _updates(spark, sf_dir)
    return rows.select("event_id", F.size(changes.diff(F.col("before"), F.col("after"), only=(1, 2))).alias("restricted"), F.size(changes.diff(F.col("before"), F.col("after"), ignored=(1,))).alias("without_value"))


@query(f"""
WITH {_PAIRS} SELECT key, count(*) AS updates, count(*) FILTER (changed > 0) AS changed_updates, count(*) FILTER (changed > 0 AND changed < 3) AS partial_updates,
  count(*) FILTER (changed > 0 AND percent < 40) AS sparse_updates, count(*) FILTER (percent > 75) AS full_updates, round(avg(percent), 4) AS avg_percent,
  round(100.0::DOUBLE * sum(changed) / sum(total), 4) AS changed_share, round(100.0::DOUBLE * count(*) FILTER (changed > 0 AND percent < 40) / count(*), 4) AS sparse_share FROM sums GROUP BY 1""")
def update_batch_stats(spark, sf_dir):
    out = changes.batch(_updates(spark, sf_dir), ["key"], 40.0).drop("mostly_sparse")
    return out.withColumns({c: F.round(c, 4) for c in ("avg_percent", "changed_share", "sparse_share")})


@query(f"WITH {_PAIRS} SELECT event_id // 100 AS batch, count(*) FILTER (percent < 70) * 2 >= count(*) AS mostly_sparse FROM sums GROUP BY 1")
def mostly_sparse_events(spark, sf_dir):
    return changes.batch(_updates(spark, sf_dir).withColumn("batch", F.floor(F.col("event_id") / 100)), ["batch"], 70.0).select("batch", "mostly_sparse")


_FREQUENCY = f"""
WITH {_PAIRS}, f AS (SELECT column_index::INT AS column_index, count(*) FILTER (a IS DISTINCT FROM b) AS changes, count(*) AS updates FROM cells GROUP BY 1)
SELECT column_index, changes, updates, round(100.0::DOUBLE * changes / updates, 4) AS percent, changes >= floor(updates * 0.9) AS frequent FROM f"""


@query(_FREQUENCY)
def column_change_frequency(spark, sf_dir):
    return changes.frequency(_updates(spark, sf_dir), 3, 0.9).withColumn("percent", F.round("percent", 4))


@query(f"SELECT column_index FROM ({_FREQUENCY}) WHERE frequent")
def frequent_columns(spark, sf_dir):
    return changes.frequency(_updates(spark, sf_dir), 3, 0.9).where("frequent").select("column_index")


@query(f"WITH {_PAIRS} SELECT {bucket_sql('floor(percent)::INT', PERCENT_BUCKETS)} AS bucket, count(*) AS updates FROM sums GROUP BY 1")
def change_pct_histogram(spark, sf_dir):
    return changes.histogram(_updates(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT event_id, a0 AS event_type, a1 AS value, a2 AS props FROM pairs")
def patched_images(spark, sf_dir):
    rows = _updates(spark, sf_dir).withColumn("image", changes.apply_diff(F.col("before"), F.col("diff")))
    return rows.select("event_id", *(F.get("image", F.lit(i)).alias(n) for i, n in enumerate(feed.FIELDS)))
